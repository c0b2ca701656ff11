"""Batches: assignment, order, length caps, padding and masks.

Every operator works on one row per utterance, except the padding of samples.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from speechlake.operators.chunks import attach_stats
from speechlake.operators.ordering import HOT_ROWS, dense_index, hash_order, hash_position
from speechlake.operators.sequences import _steps, speech_per_video


def assign_batches(
    utts: DataFrame, key: str, size: int, seed: int | None = None, epoch: int = 0, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Add ``batch``: shuffled by seed and epoch, or in key order without a seed."""
    if seed is None:
        ranked = dense_index(utts, [], [F.col(key)], F.col(key), "_rank", hot_rows)
    else:
        hashed = utts.withColumn("_digest", hash_order(f"{seed}|{epoch}", key))
        order = [F.col("_digest"), F.col(key)]
        ranked = dense_index(hashed, [], order, hash_position(F.col("_digest")), "_rank", hot_rows).drop("_digest")
    return ranked.withColumn("batch", F.floor(F.col("_rank") / F.lit(size))).drop("_rank")


def sort_in_batch(utts: DataFrame, key: str, length: str = "speech_len") -> DataFrame:
    """Add ``slot``: the longest utterance of a batch comes first."""
    w = Window.partitionBy("batch").orderBy(F.desc(length), key)
    return utts.withColumn("slot", (F.row_number().over(w) - 1).cast("int"))


def cap_lengths(
    utts: DataFrame, frame_rate: float, seconds: float = 8.0, samples_per_frame: int = 4, video_fps: float = 25.0
) -> DataFrame:
    """Padded sizes of a batch and the kept lengths of its utterances."""
    cap = max(1, round(frame_rate * seconds))
    video_cap = max(1, round(video_fps * seconds))
    k = speech_per_video(frame_rate, video_fps)
    est = F.floor(F.col("emg_len") / F.lit(samples_per_frame))
    sizes = utts.groupBy("batch").agg(
        F.least(F.max("speech_len"), F.lit(cap)).alias("max_target"),
        F.least(F.max(est), F.lit(cap)).alias("max_est"),
        F.max("video_len").alias("_video"),
    )
    ratio = float(k) if k else frame_rate / video_fps
    by_signal = F.ceil(F.col("max_est") / F.lit(ratio))
    max_video = F.when(F.col("_video") == 0, 0).otherwise(F.least(F.col("_video"), F.lit(video_cap), by_signal))
    capped = utts.join(sizes.withColumn("max_video", max_video).drop("_video"), "batch")
    video = F.least("video_len", "max_video")
    lengths = {
        "target_length": F.least("speech_len", "max_target"),
        "est_length": F.least(est, F.col("max_est")),
        "video_length": video,
        "video_est_length": F.floor(video * F.lit(ratio)),
    }
    names = ["max_target", "max_est", "max_video", *lengths]
    return capped.withColumns(lengths).withColumns({c: F.col(c).cast("int") for c in names})


def pad_samples(df: DataFrame, keys: list[str], caps: DataFrame, cap: str, filler: Column, value: str = "value") -> DataFrame:
    """Cut or fill every sequence to its padded size; ``caps`` has one row per key.

    A sequence that is missing altogether is filled from 0, so the padding comes
    from ``caps`` and not from the samples.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    plan = caps.select(*keys, F.col(cap).alias("_cap")).join(sizes, keys, "left")
    kept = attach_stats(df, plan.where("_n > 0"), keys, n="_n").where(F.col("t") < F.col("_cap"))
    have = F.coalesce("_n", F.lit(0))
    padding = plan.select(*keys, F.explode(_steps(have, F.col("_cap") - 1)).alias("t"))
    return kept.select(*keys, "t", value, F.lit(False).alias("padded")).unionByName(
        padding.select(*keys, F.col("t").cast("int").alias("t"), filler.alias(value), F.lit(True).alias("padded"))
    )


def padding_masks(caps: DataFrame, keys: list[str], length: str, size: str) -> DataFrame:
    """One row per position of the padded size; true marks padding."""
    rows = caps.select(*keys, length, F.explode(_steps(F.lit(0), F.col(size) - 1)).alias("pos"))
    return rows.select(*keys, F.col("pos").cast("int").alias("pos"), (F.col("pos") >= F.col(length)).alias("masked"))


def batch_report(padded: DataFrame) -> DataFrame:
    """Mean magnitude, share of padding and number of utterances per batch."""
    return padded.groupBy("batch").agg(
        F.avg(F.abs("value")).alias("magnitude"),
        F.avg(F.col("padded").cast("int")).alias("padding"),
        F.count_if(F.col("t") == 0).alias("utterances"),
    )
