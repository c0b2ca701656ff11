"""Manifests: paths, splits, lookups between file lists and run selection."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from speechlake.operators.chunks import attach_stats
from speechlake.operators.ordering import dense_index, hash_order, hash_position

KEY = ["session", "data_num"]


# Paths ------------------------------------------------------------------------


def path_part(path: Column, from_end: int) -> Column:
    """The k-th path component counted from the end (1 is the file name)."""
    return F.try_element_at(F.split(path, "/"), F.lit(-from_end))


def file_number(path: Column, style: str = "split") -> Column:
    """Recording number in a file name.

    ``split``: last digit run of the last ``_`` token before the first dot.
    ``index``: first digit run between ``_`` and a dot.
    """
    name = path_part(path, 1)
    if style == "index":
        digits = F.regexp_extract(name, r"_(\d+)\.", 1)
    else:
        token = F.element_at(F.split(F.substring_index(name, ".", 1), "_"), -1)
        digits = F.regexp_extract(token, r"(\d+)\D*$", 1)
    return digits.try_cast("int")


def keys_from_dataset_path(df: DataFrame, path: str = "path") -> DataFrame:
    """data_type, session and number of ``…/type/session/data/kind/file``."""
    p = F.col(path)
    return df.withColumns(
        {"data_type": path_part(p, 5), "session": path_part(p, 4), "data_num": file_number(p)}
    ).where("data_num is not null")


def keys_from_feature_path(df: DataFrame, path: str = "path") -> DataFrame:
    """split, data_type, session and index of ``…/split/type/session/idx_name``."""
    p = F.col(path)
    return df.withColumns(
        {
            "split": path_part(p, 4),
            "data_type": path_part(p, 3),
            "session": path_part(p, 2),
            "idx": F.substring_index(path_part(p, 1), "_", 1),
        }
    )


def keys_from_wav_name(df: DataFrame, path: str = "path") -> DataFrame:
    """data_type, session and index of ``…/type/session_idx.wav``."""
    p = F.col(path)
    stem = F.substring_index(path_part(p, 1), ".", 1)
    return df.withColumns(
        {
            "data_type": path_part(p, 2),
            "session": F.substring_index(stem, "_", 1),
            "idx": F.substring_index(F.substring_index(path_part(p, 1), "_", -1), ".", 1),
        }
    )


def swap_component(path: Column, old: str, new: str, extension: tuple[str, str] | None = None) -> Column:
    """Output path with one directory swapped and, if asked, another extension."""
    moved = F.replace(path, F.lit(f"/{old}/"), F.lit(f"/{new}/"))
    if extension:
        moved = F.regexp_replace(moved, rf"\.{extension[0]}$", f".{extension[1]}")
    return moved


def textgrid_path(session: Column, data_num: Column) -> Column:
    return F.concat_ws("/", session, F.lit("data/textgrid"), F.format_string("tg_%04d.TextGrid", data_num))


# Filters ----------------------------------------------------------------------


def parse_split_filter(value: str | Iterable[str] | None) -> set[str] | None:
    """None, ``*`` and blank mean no filter; otherwise a list or comma list."""
    if value is None:
        return None
    if not isinstance(value, str):
        return {str(v) for v in value}
    names = {v.strip() for v in value.split(",")} - {""}
    return None if value.strip() in ("", "*") else names


def filter_split(df: DataFrame, value: str | Iterable[str] | None) -> DataFrame:
    names = parse_split_filter(value)
    return df if names is None else df.where(F.col("split").isin(sorted(names)))


def training_view(df: DataFrame) -> DataFrame:
    """Everything for training; silent recordings only for validation and test."""
    return df.where((F.col("split") == "train") | (F.col("data_type") == "silent"))


def prefer_type(df: DataFrame, data_type: str) -> DataFrame:
    """Keep one data type, but only if it occurs at all."""
    occurs = df.agg(F.coalesce(F.bool_or(F.col("data_type") == data_type), F.lit(False))).scalar()
    return df.where((F.col("data_type") == data_type) | ~occurs)


def matching(
    df: DataFrame,
    data_type: str | None = None,
    session: str | None = None,
    data_num: int | None = None,
    sessions: Iterable[str] | None = None,
    exclude: str | None = None,
) -> DataFrame:
    """Hierarchical filter; None is a wildcard, ``exclude`` a path part to leave out."""
    for name, wanted in (("data_type", data_type), ("session", session), ("data_num", data_num)):
        if wanted is not None:
            df = df.where(F.col(name) == wanted)
    if sessions is not None:
        df = df.where(F.col("session").isin(sorted(sessions)))
    if exclude is not None:
        df = df.where(~F.col("path").contains(exclude))
    return df


# Splits -----------------------------------------------------------------------


def assign_splits(
    keys: DataFrame, ratio: tuple[float, float, float], seed: int = 42, hot_rows: int | None = None
) -> DataFrame:
    """Seeded train/valid/test split inside every session.

    The order of a session is the md5 of seed and key, so membership does not
    depend on listing order or partitioning. Counts round half to even; what
    train and valid take beyond the session is taken from valid.
    """
    if abs(sum(ratio) - 1.0) >= 1e-6:
        raise ValueError("split ratios must sum to 1")
    digest = hash_order(seed, "session", "data_num")
    extra = {} if hot_rows is None else {"hot_rows": hot_rows}
    hashed = keys.select("session", "data_num").distinct().withColumn("_digest", digest)
    ranked = dense_index(
        hashed, ["session"], [F.col("_digest"), F.col("data_num")], hash_position(F.col("_digest")), "_rank", **extra
    )
    sizes = hashed.groupBy("session").agg(F.count(F.lit(1)).alias("_n"))
    placed = attach_stats(ranked, sizes, ["session"], n="_n", t="_rank")
    n = F.col("_n")
    train = F.bround(n * F.lit(ratio[0]), 0).cast("long")
    valid = F.bround(n * F.lit(ratio[1]), 0).cast("long")
    valid = F.when(train + valid > n, F.greatest(F.lit(0), n - train)).otherwise(valid)
    rank = F.col("_rank")
    split = F.when(rank < train, "train").when(rank < train + valid, "valid").otherwise("test")
    return placed.select("session", "data_num", split.alias("split"))


def split_manifest(recordings: DataFrame, splits: DataFrame) -> DataFrame:
    """Silent rows with their split and the voiced rows that share their key."""
    return recordings.join(splits, KEY).select("session", "data_type", "data_num", "path", "split")


def split_counts(manifest: DataFrame) -> DataFrame:
    """Rows per (session, split), per session and per split in one pass."""
    return (
        manifest.groupingSets([["session", "split"], ["session"], ["split"]], "session", "split")
        .agg(F.grouping_id().alias("level"), F.count(F.lit(1)).alias("n"))
        .select("session", "split", F.col("level").cast("int").alias("level"), "n")
    )


# Lookups ----------------------------------------------------------------------


def unmatched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    return left.join(right, keys, "left_anti")


def mandatory_lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Equi join that fails the job when a row has no partner."""
    found = left.join(right.withColumn("_found", F.lit(True)), keys, "left")
    described = F.concat(F.lit(f"{value} not found for "), F.to_json(F.struct(*keys)))
    checked = F.when(F.col("_found"), F.col(value)).otherwise(F.raise_error(described))
    return found.withColumn(value, checked).drop("_found")


def optional_lookup(left: DataFrame, right: DataFrame, keys: list[str], value: str, missing: Column) -> DataFrame:
    return left.join(right, keys, "left").withColumn(value, F.coalesce(value, missing))


def first_path(df: DataFrame, keys: list[str]) -> DataFrame:
    """One path per key: the smallest, which does not depend on listing order."""
    return df.groupBy(*keys).agg(F.min("path").alias("path"))


def first_of_candidates(candidates: DataFrame, keys: list[str]) -> DataFrame:
    """Best candidate per key: lowest ``priority``, then smallest path."""
    best = F.min(F.struct("priority", "path")).alias("best")
    return candidates.groupBy(*keys).agg(best).select(*keys, "best.priority", "best.path")


def ambiguous_matches(df: DataFrame, keys: list[str]) -> DataFrame:
    """Keys with several paths, how many, and the one that is taken."""
    return (
        df.groupBy(*keys)
        .agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
        .where("n > 1")
    )


def fallback_relation(*relations: DataFrame) -> DataFrame:
    """The first relation that has any row."""
    ranked = None
    for priority, rel in enumerate(relations):
        part = rel.withColumn("_priority", F.lit(priority))
        ranked = part if ranked is None else ranked.unionByName(part)
    first = ranked.agg(F.min("_priority")).scalar()
    return ranked.where(F.col("_priority") == first).drop("_priority")


def pending(inputs: DataFrame, outputs: DataFrame, keys: list[str]) -> DataFrame:
    """Inputs that have no non-empty output yet."""
    return inputs.join(outputs.where("length > 0"), keys, "left_anti")


def neighbours(df: DataFrame, keys: list[str], num: str, value: str) -> DataFrame:
    """Value of number - 1 and number + 1; gaps give null (so not a lag)."""
    before = df.select(*keys, (F.col(num) + 1).alias(num), F.col(value).alias("before"))
    after = df.select(*keys, (F.col(num) - 1).alias(num), F.col(value).alias("after"))
    return df.join(before, [*keys, num], "left").join(after, [*keys, num], "left")


# Runs and jobs ----------------------------------------------------------------


def run_metrics(runs: DataFrame, metric: str = "val_phone_accuracy") -> DataFrame:
    """Parse checkpoint names into a tier, an epoch and a score to maximise.

    Tier 0 is ``epoch-score.ckpt``, tier 1 names the metric, tier 2 names the
    loss (negated). Names whose number does not parse are left out.
    """
    name = path_part(F.col("path"), 1)
    plain = F.regexp_extract(name, r"^(\d+)-([-+0-9.eE]+)\.ckpt$", 2)
    legacy = lambda m: F.when(
        name.rlike(rf"^epoch=.*{m}=.*\.ckpt$"), F.regexp_extract(F.col("path"), rf"{m}=([-+0-9.eE]+)", 1)
    )
    scores = F.array(
        F.struct(F.lit(0).alias("tier"), plain.try_cast("double").alias("score")),
        F.struct(F.lit(1).alias("tier"), legacy(metric).try_cast("double").alias("score")),
        F.struct(F.lit(2).alias("tier"), (-legacy("val_loss").try_cast("double")).alias("score")),
    )
    return runs.select("*", F.inline(scores)).where("score is not null")


def best_run(runs: DataFrame, metric: str = "val_phone_accuracy") -> DataFrame:
    """Best checkpoint per experiment in the first tier that has one; null if none."""
    key = F.struct("tier", (-F.col("score")).alias("loss"), "path")
    best = run_metrics(runs, metric).groupBy("exp_name").agg(F.min(key).alias("best"))
    return runs.select("exp_name").distinct().join(best, "exp_name", "left").select("exp_name", "best.path")


def latest_run(runs: DataFrame, prefix: str, missing: str | None = None) -> DataFrame:
    """Lexicographically last path with a prefix per experiment."""
    named = F.when(path_part(F.col("path"), 1).startswith(prefix), F.col("path"))
    latest = F.max(named)
    if missing is not None:
        latest = F.coalesce(latest, F.lit(missing))
    return runs.groupBy("exp_name").agg(latest.alias("path"))


def keep_best(df: DataFrame, key: str, score: str, k: int = 3) -> DataFrame:
    """The k highest scores per key (each task cuts to k rows before the shuffle)."""
    w = Window.partitionBy(key).orderBy(F.desc(score), "path")
    return df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= k).drop("_r")


def outcome_counts(jobs: DataFrame) -> DataFrame:
    """Outcome counts per session and in total (session null)."""
    status = F.col("status")
    return jobs.rollup("session").agg(
        F.count(F.lit(1)).alias("scanned"),
        F.count_if(status != "failed").alias("parsed"),
        F.count_if(status == "changed").alias("changed"),
        F.count_if(status == "skipped").alias("skipped"),
        F.count_if(status == "failed").alias("failed"),
    )


def outcome_examples(jobs: DataFrame, n: int = 20) -> DataFrame:
    """The first n paths of every outcome."""
    w = Window.partitionBy("status").orderBy("path")
    return jobs.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
