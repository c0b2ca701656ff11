"""Positions and running totals that survive a hot key.

A plain ``row_number() over (partition by key)`` sends every row of a key to
one task. Here a key of more than ``HOT_ROWS`` rows is first cut at quantiles of
the order column, taken from a sketch of that key, into as many buckets as its
rows call for; the window runs inside (key, bucket) and the totals of the
earlier buckets are added afterwards. Where no key is hot, the plain window is
the whole plan.

The table of hot keys has at most one cut per ``HOT_ROWS`` rows of the data; it
and the bucket totals are written out, so the planner knows their size and
broadcasts them only if they are small.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from speechlake.functions.let import let
from speechlake.sources.scratch import stored

HOT_ROWS = 1 << 20


def _hot_keys(df: DataFrame, keys: list[str], position: Column, hot_rows: int) -> DataFrame | None:
    """Keys to split and their cuts in order, in runs of about equal number."""
    counts = stored(df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hot_rows), "hot-keys")
    largest = counts.agg(F.max("_n")).first()[0]
    if largest is None:
        return None
    buckets = -(-largest // hot_rows)
    run = int(buckets**0.5) + 1
    named = counts.select(*[F.col(k).alias(f"_k_{k}") for k in keys])
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    shares = F.array(*[F.lit(i / buckets) for i in range(1, buckets)])
    sketch = F.percentile_approx(F.col("_at"), shares, max(10_000, 4 * buckets))
    cuts = F.array_sort(F.array_distinct("_cuts"))
    runs = F.transform(F.sequence(F.lit(0), F.floor((F.size("_cuts") - 1) / run).cast("int")), lambda i: F.slice("_cuts", i * run + 1, run))
    made = df.withColumn("_at", position.cast("double")).join(named, on, "left_semi").groupBy(*keys).agg(sketch.alias("_cuts"))
    return stored(made.withColumn("_cuts", cuts).select(*[F.col(k).alias(f"_k_{k}") for k in keys], runs.alias("_runs"), F.lit(run).alias("_run")), "cuts")


def _bucketed(df: DataFrame, keys: list[str], position: Column, hot: DataFrame) -> DataFrame:
    """Adds ``_bucket``: how many cuts of its key lie below the position."""
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    at = position.cast("double")
    full = F.size(F.filter("_runs", lambda r: F.element_at(r, -1) < at))
    part = lambda n: n * F.col("_run") + F.size(F.filter(F.coalesce(F.get("_runs", n), F.array().cast("array<double>")), lambda c: c < at))
    slot = F.when(F.col("_runs").isNull() | at.isNull(), 0).otherwise(let(full, part))
    return (
        df.join(hot, on, "left")
        .withColumn("_split", F.col("_runs").isNotNull())
        .withColumn("_bucket", slot.cast("int"))
        .drop("_runs", "_run", *[f"_k_{k}" for k in keys])
    )


def _with_total(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    position: Column,
    weight: Column,
    name: str,
    hot_rows: int,
) -> DataFrame:
    """Sum of ``weight`` over all earlier rows of the key (exclusive)."""
    added = not keys
    if added:
        df, keys = df.withColumn("_all", F.lit(0)), ["_all"]
    zero = F.lit(0)
    earlier = lambda *by: Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    hot = _hot_keys(df, keys, position, hot_rows)
    weighed = df.withColumn("_w", weight)
    if hot is None:
        out = weighed.withColumn(name, F.coalesce(F.sum("_w").over(earlier(*keys)), zero)).drop("_w")
        return out.drop("_all") if added else out
    rows = _bucketed(weighed, keys, position, hot)
    before = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.where("_split").groupBy(*keys, "_bucket").agg(F.sum("_w").alias("_total"))
    totals = stored(totals.withColumn("_before", F.sum("_total").over(before)).select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_bucket").alias("_of"), "_before"), "bucket-totals")
    same = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys] + [F.col("_bucket") == F.col("_of")]
    out = (
        rows.withColumn("_local", F.coalesce(F.sum("_w").over(earlier(*keys, "_bucket")), zero))
        .join(totals, same, "left")
        .withColumn(name, F.col("_local") + F.coalesce("_before", zero))
        .drop("_w", "_bucket", "_split", "_local", "_before", "_of", *[f"_k_{k}" for k in keys])
    )
    return out.drop("_all") if added else out


def dense_index(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    position: Column,
    name: str = "t",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the 0-based position of every row inside its key.

    ``position`` is a number that never decreases along ``order``; it decides
    where a hot key is cut. ``order`` must be a total order.
    """
    out = _with_total(df, keys, order, position, F.lit(1).cast("long"), name, hot_rows)
    return out.withColumn(name, F.col(name).cast("long"))


def running_offset(
    df: DataFrame,
    keys: list[str],
    order: list[Column],
    position: Column,
    weight: Column,
    name: str = "offset",
    hot_rows: int = HOT_ROWS,
) -> DataFrame:
    """Add the sum of ``weight`` over all earlier rows of the key."""
    return _with_total(df, keys, order, position, weight, name, hot_rows)


def hash_order(seed: int | str, *cols: str | Column) -> Column:
    """Reproducible pseudo-random order: md5 of the seed and the key."""
    return F.md5(F.concat_ws("|", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols]))


def hash_position(digest: Column) -> Column:
    """The leading 32 bits of an md5 digest as a number, monotone in the digest."""
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")
