"""Mergeable statistics, normalisers and distribution reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.operators.chunks import attach_stats
from speechlake.operators.ordering import HOT_ROWS, running_offset

STD_FLOOR = 1e-8


def dim_moments(df: DataFrame, column: str, eps: float = STD_FLOOR) -> DataFrame:
    """Count, mean, squared deviation and floored population deviation per dimension.

    Partial sums merge on the map side, so one row per dimension and task is shuffled.
    """
    values = df.select(F.posexplode(F.col(column)).alias("dim", "x")).withColumn("x", F.col("x").cast("double"))
    stats = values.groupBy("dim").agg(
        F.count("x").alias("n"), F.avg("x").alias("mean"), F.var_pop("x").alias("var")
    )
    return stats.select(
        "dim", "n", "mean", (F.col("var") * F.col("n")).alias("m2"), F.greatest(F.sqrt("var"), F.lit(eps)).alias("std")
    )


def paired_moments(rows: DataFrame, column: str, paired: DataFrame, paired_column: str) -> DataFrame:
    """Moments over all rows plus the voiced partners of the silent ones."""
    both = rows.select(F.col(column).alias("x")).unionByName(paired.select(F.col(paired_column).alias("x")))
    return dim_moments(both, "x")


def require_rows(stats: DataFrame) -> DataFrame:
    """Fail the job if no sample was accumulated."""
    seen = stats.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).select(
        F.when(F.col("n") > 0, F.col("n")).otherwise(F.raise_error(F.lit("no samples were accumulated")))
    )
    return stats.where(seen.scalar() > 0)


def global_moments(df: DataFrame, column: str, dims: int) -> DataFrame:
    """One mean and deviation over all values, repeated for every dimension."""
    values = df.select(F.explode(column).alias("x")).withColumn("x", F.col("x").cast("double"))
    stats = values.agg(F.count("x").alias("n"), F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"))
    return stats.select(F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim"), "n", "mean", "std")


def _as_array(stats: DataFrame) -> Column:
    """Per-dimension (mean, std), at most one entry per dimension, as one value."""
    packed = F.sort_array(F.collect_list(F.struct("dim", "mean", "std")))
    return stats.agg(packed).scalar()


def normalize(df: DataFrame, column: str, stats: DataFrame) -> DataFrame:
    scaled = F.zip_with(F.col(column), "_stats", lambda x, s: (x - s["mean"]) / s["std"])
    return df.withColumn("_stats", _as_array(stats)).withColumn(column, scaled).drop("_stats")


def denormalize(df: DataFrame, column: str, stats: DataFrame) -> DataFrame:
    restored = F.zip_with(F.col(column), "_stats", lambda x, s: x * s["std"] + s["mean"])
    return df.withColumn("_stats", _as_array(stats)).withColumn(column, restored).drop("_stats")


def median(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Exact median without bringing the values into one task.

    Equal values collapse to a count first; ranks come from running totals that
    are cut into buckets of the value range.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count(F.lit(1)).alias("c"))
    total = counts.agg(F.sum("c")).scalar()
    placed = running_offset(counts, [], [F.col("v")], F.col("v"), F.col("c"), "before", hot_rows)
    low, high = F.floor((total - 1) / F.lit(2)), F.floor(total / F.lit(2))
    holds = lambda r: (F.col("before") <= r) & (r < F.col("before") + F.col("c"))
    return placed.agg(
        ((F.max(F.when(holds(low), F.col("v"))) + F.max(F.when(holds(high), F.col("v")))) / 2).alias("median")
    )


def describe(df: DataFrame, column: str, hot_rows: int = HOT_ROWS) -> DataFrame:
    x = F.col(column)
    return df.agg(
        F.count(x).alias("n"), F.min(x).alias("min"), F.max(x).alias("max"), F.avg(x).alias("mean"),
        F.stddev_pop(x).alias("std"),
    ).withColumn("median", median(df, column, hot_rows).scalar())


def histogram(df: DataFrame, column: str, bins: int = 50) -> DataFrame:
    """Equal-width bins over the value range; the last bin is closed, empty bins stay."""
    x = F.col(column)
    low = F.when(F.min(x) == F.max(x), F.min(x) - 0.5).otherwise(F.min(x))
    high = F.when(F.min(x) == F.max(x), F.max(x) + 0.5).otherwise(F.max(x))
    span = df.agg(F.struct(low.alias("lo"), high.alias("hi"))).scalar()
    slot = F.least(F.width_bucket(x, span["lo"], span["hi"], F.lit(bins)), F.lit(bins))
    counts = df.where(x.isNotNull()).groupBy(slot.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = df.sparkSession.range(1, bins + 1).select(F.col("id").cast("int").alias("bin"))
    step = (span["hi"] - span["lo"]) / bins
    return grid.join(counts, "bin", "left").select(
        "bin", (span["lo"] + step * (F.col("bin") - 1)).alias("edge"), F.coalesce("n", F.lit(0)).alias("n")
    )


def loudest_channel(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Channel with the largest energy; the lower channel wins a tie."""
    energy = signal.groupBy(*keys, "ch").agg(F.sum(F.col("value") * F.col("value")).alias("energy"))
    return energy.groupBy(*keys).agg(
        F.max_by("ch", F.struct("energy", -F.col("ch"))).alias("ch"), F.max("energy").alias("energy")
    )


def loudest_samples(signal: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, t, value`` of the loudest channel of every sequence.

    Energies and lengths come from one partial aggregate; the winners meet the
    samples on (keys, channel, chunk), so a long sequence is many small keys.
    """
    energy = signal.groupBy(*keys, "ch").agg(F.sum(F.col("value") * F.col("value")).alias("energy"), F.count(F.lit(1)).alias("_n"))
    best = energy.groupBy(*keys).agg(F.max_by(F.struct("ch", "_n"), F.struct("energy", -F.col("ch"))).alias("_w"))
    winners = best.select(*keys, F.col("_w.ch").alias("ch"), F.col("_w._n").alias("_n"))
    return attach_stats(signal, winners, [*keys, "ch"], n="_n").select(*keys, "t", "value")
