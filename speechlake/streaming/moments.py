"""Running moments of whole vectors.

A task reduces its rows to one (n, mean, squared deviation) per key, as arrays
over the dimensions; the state of a key holds the same and takes them in by the
parallel formula of Chan et al. So a key of any number of rows is one row per
task in the shuffle, and a stream that is started again goes on from its state.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechlake.operators.stats import STD_FLOOR

# Keys that a task holds before it passes them on.
HELD = 10_000

Moments = tuple[np.ndarray, np.ndarray, np.ndarray]
_ARRAYS = "n array<long>, mean array<double>, m2 array<double>"


def moments(x: np.ndarray, valid: np.ndarray) -> Moments:
    """Count, mean and squared deviation of every column; invalid cells don't count."""
    n = valid.sum(axis=0)
    mean = np.where(valid, x, 0.0).sum(axis=0) / np.maximum(n, 1)
    gap = np.where(valid, x - mean, 0.0)
    return n, mean, (gap * gap).sum(axis=0)


def merged(a: Moments | None, b: Moments) -> Moments:
    """Moments of two sets of rows together."""
    if a is None:
        return b
    if len(a[0]) != len(b[0]):
        raise ValueError("vectors differ in length")
    n = a[0] + b[0]
    share = b[0] / np.maximum(n, 1)
    gap = b[1] - a[1]
    return n, a[1] + gap * share, a[2] + b[2] + gap * gap * a[0] * share


def _partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[object, Moments] = {}
    kind = None

    def passed_on() -> pa.RecordBatch:
        columns = [pa.array(list(held), kind)]
        columns += [pa.array([m[k] for m in held.values()], pa.list_(t)) for k, t in enumerate((pa.int64(), pa.float64(), pa.float64()))]
        held.clear()
        return pa.RecordBatch.from_arrays(columns, ["key", "n", "mean", "m2"])

    for batch in batches:
        kind = batch.column("key").type
        rows = batch.filter(batch.column("x").is_valid())
        sizes = np.diff(rows.column("x").offsets.to_numpy())
        if not len(sizes):
            continue
        if sizes.min() != sizes.max():
            raise ValueError("vectors differ in length")
        flat = rows.column("x").flatten()
        valid = flat.is_valid().to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(len(sizes), -1)
        coded = rows.column("key").dictionary_encode(null_encoding="encode")
        at, names = coded.indices.to_numpy(), coded.dictionary.to_pylist()
        order = np.argsort(at, kind="stable")
        ends = np.searchsorted(at[order], np.arange(len(names) + 1))
        for k, name in enumerate(names):
            own = order[ends[k] : ends[k + 1]]
            held[name] = merged(held.get(name), moments(x[own], valid[own]))
        if len(held) > HELD:
            yield passed_on()
    if held:
        yield passed_on()


def _take_in(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    known = tuple(np.array(x) for x in state.get) if state.exists else None
    for frame in frames:
        for row in zip(*(frame[c] for c in ("n", "mean", "m2"))):
            known = merged(known, tuple(np.array(x) for x in row))
    found = tuple(x.tolist() for x in known)
    state.update(found)
    yield pd.DataFrame({"key": [key[0]], **{c: [x] for c, x in zip(("n", "mean", "m2"), found)}})


def vector_moments(stream: DataFrame, key: str, column: str) -> DataFrame:
    """``key, n, mean, m2`` (arrays over the dimensions) in update mode.

    Null vectors are left out and null cells of a dimension don't count in it;
    vectors of different lengths are an error; a null key is a key.
    """
    kind = stream.schema[key].dataType.simpleString()
    rows = stream.select(F.col(key).alias("key"), F.col(column).cast("array<double>").alias("x"))
    parts = rows.mapInArrow(_partial, f"key {kind}, {_ARRAYS}")
    return parts.groupBy("key").applyInPandasWithState(_take_in, f"key {kind}, {_ARRAYS}", _ARRAYS, "update", GroupStateTimeout.NoTimeout)


def per_dimension(found: DataFrame, eps: float = STD_FLOOR) -> DataFrame:
    """``key, dim, n, mean, m2, std``; a dimension without values has a null mean."""
    rows = found.select("key", F.posexplode_outer(F.arrays_zip("n", "mean", "m2")).alias("dim", "v")).select("key", "dim", "v.*")
    std = F.greatest(F.sqrt(F.col("m2") / F.col("n")), F.lit(eps))
    seen = F.col("n") > 0
    return rows.select("key", "dim", "n", F.when(seen, F.col("mean")).alias("mean"), F.when(seen, F.col("m2")).alias("m2"), F.when(seen, std).alias("std"))
