"""Array and sound files to sequence rows (one-off ingest to Parquet)."""

from __future__ import annotations

import io
import uuid
import wave
from collections.abc import Iterator
from fnmatch import fnmatchcase
from functools import reduce

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators.chunks import spread
from speechlake.sources.scratch import stored

SLICE = 4096
# Bytes of files that a task reads before it passes them on.
READ = 1 << 24


def _load(content: bytes, key: str | None) -> np.ndarray:
    loaded = np.load(io.BytesIO(content), allow_pickle=False)
    if isinstance(loaded, np.lib.npyio.NpzFile):
        loaded = loaded[key]
    return loaded.reshape(len(loaded), -1) if loaded.ndim else loaded.reshape(1, 1)


def decode_arrays(files: DataFrame, key: str | None = "data") -> DataFrame:
    """(path, content) of npy or npz files to (path, t, x): one row per step.

    A file is read in one task, its rows leave in slices.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                matrix = _load(content, key).astype(np.float64)
                for at in range(0, len(matrix), SLICE):
                    part = matrix[at : at + SLICE]
                    steps = np.arange(at, at + len(part), dtype=np.int32)
                    yield pd.DataFrame({"path": path, "t": steps, "x": list(part)})

    return files.select("path", "content").mapInPandas(rows, "path string, t int, x array<double>")


def decode_wav(files: DataFrame, rate: int | None = None) -> DataFrame:
    """(path, content) of 16-bit PCM files to (path, rate, ch, t, value) in [-1, 1).

    With ``rate`` given, another sampling rate is an error.
    """

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                with wave.open(io.BytesIO(content)) as sound:
                    if sound.getsampwidth() != 2:
                        raise ValueError(f"{path}: only 16-bit samples are read")
                    if rate is not None and sound.getframerate() != rate:
                        raise ValueError(f"{path}: rate {sound.getframerate()} is not {rate}")
                    at = 0
                    while len(raw := sound.readframes(SLICE)):
                        block = np.frombuffer(raw, dtype="<i2").reshape(-1, sound.getnchannels()) / 32768.0
                        n, channels = block.shape
                        yield pd.DataFrame(
                            {
                                "path": path,
                                "rate": np.int32(sound.getframerate()),
                                "ch": np.tile(np.arange(channels, dtype=np.int32), n),
                                "t": np.repeat(np.arange(at, at + n, dtype=np.int32), channels),
                                "value": block.ravel(),
                            }
                        )
                        at += n

    return files.select("path", "content").mapInPandas(rows, "path string, rate int, ch int, t int, value double")


def _file_system(root: str) -> tuple[fs.FileSystem, str]:
    if root.startswith("file:"):
        root = "/" + root[5:].lstrip("/")
    return (fs.LocalFileSystem(), root) if root.startswith("/") else fs.FileSystem.from_uri(root)


def write_binary(files: DataFrame, root: str) -> int:
    """Write (path, content) as files below a shared folder; returns their number.

    Tasks write their own files, each under another name first, so a file is
    whole or missing and a task that runs again replaces what it wrote.
    """

    def save(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, base = _file_system(root)
        made: set[str] = set()
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                target = f"{base}/{path}"
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    system.create_dir(folder, recursive=True)
                    made.add(folder)
                hidden = f"{folder}/_{uuid.uuid4().hex}"
                with system.open_output_stream(hidden) as out:
                    out.write(content)
                system.move(hidden, target)
            yield pd.DataFrame({"n": [len(batch)]})

    written = files.select("path", "content").mapInPandas(save, "n long").agg(F.sum("n")).first()[0]
    return written or 0


def _hidden(name: str) -> bool:
    return name.startswith(".") or (name.startswith("_") and "=" not in name)


def list_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder whose names fit a shell pattern.

    Tasks list the folders, level by level, so neither the driver nor a task
    ever holds more than the names in one folder. Hidden names are left out.
    """
    root = root.rstrip("/")
    base = _file_system(root)[1]
    prefix = root[: len(root) - len(base)] if not root.startswith(("/", "file:")) else "file:"

    def entries(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = _file_system(root)[0]
        for batch in batches:
            for folder in batch["path"]:
                info = system.get_file_info(folder)
                found = [info] if info.is_file else system.get_file_info(fs.FileSelector(folder))
                for at in range(0, len(found), SLICE):
                    part = [f for f in found[at : at + SLICE] if not _hidden(f.base_name) and (not f.is_file or fnmatchcase(f.base_name, pattern))]
                    yield pd.DataFrame(
                        {"path": [f.path for f in part], "length": [f.size or 0 for f in part], "folder": [not f.is_file for f in part]}
                    ).astype({"path": "object", "length": "int64", "folder": "bool"})

    folders, files = spark.createDataFrame([(base,)], "path string"), []
    while not files or not folders.isEmpty():
        level = stored(spread(folders, "path").mapInPandas(entries, "path string, length long, folder boolean"), "listed")
        files.append(level.where("NOT folder").select(F.concat(F.lit(prefix), "path").alias("path"), "length"))
        folders = level.where("folder").select("path")
    return reduce(DataFrame.union, files)


def read_binary(spark: SparkSession, root: str, pattern: str) -> DataFrame:
    """(path, content) of the files that :func:`list_files` finds, read by tasks."""
    base = _file_system(root)[1].rstrip("/")

    def contents(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system = _file_system(root)[0]
        for batch in batches:
            paths, held, size = [], [], 0
            for path in batch["path"]:
                with system.open_input_stream(base + path[path.index(base) + len(base) :]) as file:
                    paths.append(path)
                    held.append(file.read())
                size += len(held[-1])
                if size >= READ:
                    yield pd.DataFrame({"path": paths, "content": held})
                    paths, held, size = [], [], 0
            if paths:
                yield pd.DataFrame({"path": paths, "content": held})

    return spread(list_files(spark, root, pattern).select("path"), "path").mapInPandas(contents, "path string, content binary")
