"""Statistics and error rates that grow with arriving files.

Each is the streaming form of a batch aggregate: the state store keeps one
mergeable buffer per key, micro-batches only add to it.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.sources.scratch import scratch_path


def file_stream(spark: SparkSession, path: str, schema, files_per_batch: int = 1000) -> DataFrame:
    """Arriving files; the caller says how many make a micro-batch."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)


def running_moments(stream: DataFrame, key: str, value: str, eps: float = 1e-8) -> DataFrame:
    """Count, mean and floored population deviation per key."""
    return stream.groupBy(key).agg(
        F.count(value).alias("n"), F.avg(value).alias("mean"), F.greatest(F.stddev_pop(value), F.lit(eps)).alias("std")
    )


def running_rates(stream: DataFrame, key: str) -> DataFrame:
    """Summed errors and lengths per key; the rate is their quotient."""
    return stream.groupBy(key).agg(F.sum("err").alias("err"), F.sum("len").alias("len"))


def daily_rates(stream: DataFrame, ts: str, key: str, delay: str) -> DataFrame:
    """Sums per closed event-time day: a day is final once the watermark has passed it."""
    day = F.window(ts, "1 day")
    grouped = stream.withWatermark(ts, delay).groupBy(day.alias("day"), key)
    return grouped.agg(F.sum("err").alias("err"), F.sum("len").alias("len")).select(
        F.col("day.start").alias("day"), key, "err", "len"
    )


def paired(predictions: DataFrame, targets: DataFrame, keys: list[str], ts: str, delay: str, within: str) -> DataFrame:
    """Join arriving predictions and targets of the same keys, each pair once.

    Both carry an event time. A prediction or target that is sent again within
    ``delay`` counts once; one that arrives more than ``delay`` behind the newest
    of its stream, once the watermark has passed it, is dropped. Partners are at
    most ``within`` apart, so the state of either side ends. Other columns must
    not share names.
    """
    left = predictions.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    right = targets.withWatermark(ts, delay).dropDuplicatesWithinWatermark(keys)
    renamed = right.withColumnsRenamed({c: f"_{c}" for c in [*keys, ts]})
    span = F.expr(f"INTERVAL {within}")
    near = (F.col(f"_{ts}") >= F.col(ts) - span) & (F.col(f"_{ts}") <= F.col(ts) + span)
    same = [F.col(k) == F.col(f"_{k}") for k in keys]
    return left.join(renamed, [*same, near]).drop(*[f"_{c}" for c in [*keys, ts]])


def run_summed(rows: DataFrame, keys: list[str], sums: list[str], label: str, out: str | None = None) -> DataFrame:
    """Process all available input; return sums of final rows per key.

    A micro-batch writes its own sums to a folder of its own. With the ``out``
    of an earlier run the stream goes on where that one stopped.
    """
    spark = rows.sparkSession
    out = out or scratch_path(spark, label)
    total = lambda df: df.groupBy(*keys).agg(*(F.sum(c).alias(c) for c in sums))

    def save(batch: DataFrame, batch_id: int) -> None:
        total(batch).write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    stream = rows.select(*keys, *sums).writeStream.outputMode("append").foreachBatch(save)
    stream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return total(spark.read.parquet(f"{out}/table"))


def run_updated(result: DataFrame, keys: list[str], label: str, out: str | None = None) -> DataFrame:
    """Process all available input; return the last result of every key.

    A micro-batch writes the keys it changed to a folder of its own, so a
    repeated batch replaces itself; reading takes the latest row per key. With
    the ``out`` of an earlier run the stream goes on where that one stopped.
    """
    spark = result.sparkSession
    out = out or scratch_path(spark, label)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/table/batch={batch_id}")

    stream = result.writeStream.outputMode("update").foreachBatch(save)
    stream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    rest = [c for c in result.columns if c not in keys]
    latest = F.max_by(F.struct(*rest), "batch").alias("_latest")
    return spark.read.parquet(f"{out}/table").groupBy(*keys).agg(latest).select(*keys, "_latest.*").select(*result.columns)


def run_append(result: DataFrame, label: str) -> DataFrame:
    """Process all available input; return the rows that are final."""
    spark = result.sparkSession
    out = scratch_path(spark, label)
    stream = result.writeStream.outputMode("append").format("parquet").option("path", f"{out}/table")
    stream.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(result.schema).parquet(f"{out}/table")
