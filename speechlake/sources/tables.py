"""Text, CSV, JSON and Parquet tables of a corpus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlake.functions.text import normalize_basic
from speechlake.operators.manifest import file_number, path_part
from speechlake.sources.arrayfiles import list_files, read_binary

SPLIT_DDL = "session STRING, data_type STRING, data_num INT, path STRING, split STRING"
METADATA_FIELDS = ["id", "text", "norm"]
RESULT_COLUMNS = ["exp_name", "ckpt_epoch", "split", "cer", "cer_wo_space", "wer"]


# Manifests ----------------------------------------------------------------------


def scan_files(spark: SparkSession, root: str, pattern: str = "*") -> DataFrame:
    """(path, length) of all files below a folder; their content is not read."""
    return list_files(spark, root, pattern)


def scan_manifest(spark: SparkSession, root: str, pattern: str = "*.npz", style: str = "split", foldered: bool = False) -> DataFrame:
    """Files named ``…/data_type/session/data/kind/file`` with their keys.

    With ``foldered`` a recording is a folder of that name with parts in it, as
    partitioned writers leave it (``key=`` before a name does not count).
    """
    p = F.col("path")
    files = scan_files(spark, root, pattern)
    if foldered:
        folder = F.regexp_replace(F.regexp_extract("path", "^(.*)/[^/]+$", 1), "/[a-z_]+=", "/")
        files = files.groupBy(folder.alias("path")).agg(F.sum("length").alias("length"))
    keyed = files.select(
        path_part(p, 5).alias("data_type"), path_part(p, 4).alias("session"), file_number(p, style).alias("data_num"),
        path_part(p, 2).alias("modality"), "path", "length",
    )
    return keyed.where("data_num is not null")


def sessions(manifest: DataFrame) -> DataFrame:
    return manifest.select("session").distinct().orderBy("session")


def read_split_csv(spark: SparkSession, path: str) -> DataFrame:
    """Split table; numbers are integers, so zero-padded ones match."""
    return spark.read.schema(SPLIT_DDL).csv(path, header=True)


def write_split_csv(df: DataFrame, path: str) -> None:
    df.select("session", "data_type", "data_num", "path", "split").write.mode("overwrite").csv(path, header=True, encoding="UTF-8")


# Transcripts --------------------------------------------------------------------


def read_metadata(spark: SparkSession, path: str) -> DataFrame:
    """``id|text|normalised`` lines without quoting; blank lines and those without
    an id are dropped. A field that a line lacks is null, an empty one is empty."""
    fields = F.split("value", r"\|", -1)
    lines = spark.read.text(path).where(F.col("value").rlike(r"[^\x00-\x20]") & ~F.col("value").startswith("|"))
    return lines.select(*[F.get(fields, F.lit(k)).alias(name) for k, name in enumerate(METADATA_FIELDS)])


def metadata_texts(metadata: DataFrame) -> DataFrame:
    """id without its first folder, and the a-z form of its text."""
    tail = F.regexp_replace("id", "^[^/]*/?", "")
    return metadata.select(tail.alias("id"), normalize_basic(F.col("text")).alias("text"))


def read_transcripts(spark: SparkSession, path: str, multi_line: bool = True, fields: str = "text STRING", pattern: str = "*") -> DataFrame:
    """``path`` and fields of JSON files, one object per line, or else one object (or
    a list of them) per file below the folder ``path``; a broken one has null fields."""
    if not multi_line:
        docs = spark.read.schema(fields).json(path)
        return docs.select(F.col("_metadata.file_path").alias("path"), "*")
    objects = F.from_json(F.col("content").cast("string"), T.ArrayType(T.StructType.fromDDL(fields)))
    return read_binary(spark, path, pattern).select("path", F.inline_outer(objects))


def eval_log_lines(df: DataFrame) -> DataFrame:
    """Three report lines per scored sample: (i, k, value).

    Columns i, session, idx, target, prediction and the error counts.
    """
    rate = lambda e, n: F.format_string("%.2f", F.col(e) / F.col(n) * 100)
    i = F.col("i").cast("string")
    head = lambda kind, c: F.concat(F.lit(kind), i, F.lit(" "), F.col("session"), F.lit(" "), F.col("idx"), F.lit(": "), F.col(c))
    score = F.concat(i, F.lit(" sample cer: "), rate("char_err", "char_len"), F.lit(", wer: "), rate("word_err", "word_len"))
    return df.select("i", F.posexplode(F.array(head("trgt", "target"), head("pred", "prediction"), score)).alias("k", "value"))


def parse_eval_log(lines: DataFrame) -> DataFrame:
    """Pair the target and prediction line of every sample; incomplete samples are left out."""
    pattern = r"^(trgt|pred)(\d+) (\S+) (\S+?): ?(.*)$"
    part = lambda g: F.regexp_extract("value", pattern, g)
    rows = lines.where(F.col("value").rlike(pattern)).select(
        part(1).alias("kind"), part(2).cast("long").alias("i"), part(3).alias("session"), part(4).alias("idx"),
        F.trim(F.regexp_replace(part(5), r"(?U)\s+", " ")).alias("text"),
    )
    text_of = lambda kind: F.max(F.when(F.col("kind") == kind, F.col("text")))
    return (
        rows.groupBy("i")
        .agg(F.max("session").alias("session"), F.max("idx").alias("idx"), text_of("trgt").alias("target"), text_of("pred").alias("prediction"))
        .where("target is not null and prediction is not null")
    )


# Inventories and normalisers ------------------------------------------------------


def parse_phoneme_set(json: Column) -> Column:
    """Phones of either accepted form with ``sil`` added; other documents are an error."""
    listed = F.from_json(json, "ARRAY<STRING>")
    wrapped = F.from_json(json, "STRUCT<phonemes: ARRAY<STRING>, count: INT>")["phonemes"]
    phones = F.when(json.rlike(r"^\s*\["), listed).otherwise(wrapped)
    known = F.when(phones.isNull(), F.raise_error(F.lit("unsupported phoneme set"))).otherwise(phones)
    return F.when(F.array_contains(known, "sil"), known).otherwise(F.concat(known, F.array(F.lit("sil"))))


def read_phoneme_set(spark: SparkSession, path: str) -> DataFrame:
    doc = spark.read.text(path, wholetext=True)
    return doc.select(F.posexplode(parse_phoneme_set(F.col("value"))).alias("phone_id", "phone"))


def write_phoneme_set(phones: DataFrame, path: str) -> None:
    """Sorted distinct phones with their count as one JSON document."""
    packed = phones.select("phone").distinct().agg(F.sort_array(F.collect_list("phone")).alias("phonemes"))
    doc = packed.select(F.to_json(F.struct("phonemes", F.size("phonemes").alias("count"))).alias("value"))
    doc.coalesce(1).write.mode("overwrite").text(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def stored_or_computed(spark: SparkSession, path: str, compute) -> DataFrame:
    """The stored statistics if there are any, else compute and store them."""
    if not _exists(spark, f"{path}/_SUCCESS"):
        compute().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


# Features and results -------------------------------------------------------------


def write_features(df: DataFrame, path: str) -> None:
    """Features below split / data_type / session; rows of a folder meet in few files.

    Rebalancing deals the rows by folder and splits a large one over as many
    tasks as its size calls for.
    """
    parts = ["split", "data_type", "session"]
    df.hint("rebalance", *parts).write.mode("overwrite").partitionBy(*parts).parquet(path)


def append_results(results: DataFrame, path: str) -> None:
    """Append rates, in percent with two decimals, to the result table."""
    percent = lambda c: F.format_string("%.2f", F.col(c) * 100).alias(c)
    rows = results.select("exp_name", "ckpt_epoch", "split", percent("cer"), percent("cer_wo_space"), percent("wer"))
    rows.write.mode("append").csv(path, header=True)


def read_results(spark: SparkSession, path: str) -> DataFrame:
    ddl = "exp_name STRING, ckpt_epoch INT, split STRING, cer DOUBLE, cer_wo_space DOUBLE, wer DOUBLE"
    return spark.read.schema(ddl).csv(path, header=True)
