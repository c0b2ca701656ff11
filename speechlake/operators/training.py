"""From the modalities of an utterance to padded batches, in one plan.

All modalities are one relation (utt, modality, t, x), where ``x`` is a vector.
Their lengths come from one partial aggregate. Everything after that, the common
lengths, the edges, the batches and their caps, is arithmetic on one row per
utterance: per modality it ends in a first step, a number of steps and a padded
size. So the samples are shuffled once, to meet these three numbers on (utt,
modality, chunk); no trim is a join of its own, and padding comes from the plan.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.operators import batches, sequences
from speechlake.operators.chunks import attach_stats

MODALITIES = ("speech", "phone", "emg", "voiced", "video")


def modality_lengths(rows: DataFrame, utterances: DataFrame) -> DataFrame:
    """``utt, silent`` and a length per modality; a missing one has length 0."""
    sizes = rows.groupBy("utt").agg(*(F.count_if(F.col("modality") == m).cast("int").alias(f"{m}_len") for m in MODALITIES))
    known = utterances.select("utt", "silent").join(sizes, "utt", "left")
    filled = {f"{m}_len": F.coalesce(f"{m}_len", F.lit(0)) for m in MODALITIES}
    return known.withColumns(filled).withColumn("voiced_len", F.when(F.col("silent"), F.col("voiced_len")))


def windows(lengths: DataFrame, frame_rate: float, edge_seconds: float, samples_per_frame: int = 4, video_fps: float = 25.0) -> DataFrame:
    """Add first step and number of steps per modality: cut to the common length
    around the centre, then the edges off on both sides."""
    targets = sequences.alignment_targets(lengths, frame_rate, samples_per_frame, video_fps)
    edge = sequences.edge_steps(frame_rate, edge_seconds, samples_per_frame, video_fps)
    edge |= {"phone": edge["speech"], "voiced": edge["emg"]}
    added: dict[str, Column] = {}
    for m in MODALITIES:
        n = F.coalesce(f"{m}_len", F.lit(0))
        want = F.greatest(F.least(F.coalesce(f"{m}_to", F.lit(0)), n), F.lit(0))
        added[f"{m}_start"] = (F.floor((n - want) / F.lit(2)) + edge[m]).cast("int")
        added[f"{m}_keep"] = F.greatest(want - 2 * edge[m], F.lit(0)).cast("int")
    return targets.withColumns(added)


def batch_plan(
    items: DataFrame, size: int, seed: int | None, frame_rate: float, epoch: int = 0, seconds: float = 8.0, samples_per_frame: int = 4, video_fps: float = 25.0
) -> DataFrame:
    """A row per utterance and modality: ``batch, slot, start, kept, size, n``.

    ``items`` is what :func:`windows` gives, stored: ranking reads it several
    times. ``n`` is the length that the samples have.
    """
    cut = items.select("utt", *(F.col(f"{m}_keep").alias(f"{m}_len") for m in ("speech", "emg", "video")))
    batched = batches.sort_in_batch(batches.assign_batches(cut, "utt", size, seed, epoch), "utt")
    capped = batches.cap_lengths(batched, frame_rate, seconds, samples_per_frame, video_fps)
    padded = {m: F.col("max_target") for m in ("speech", "phone")} | {"video": F.col("max_video")}
    padded |= {m: F.col("max_est") * samples_per_frame for m in ("emg", "voiced")}
    both = capped.select("utt", "batch", "slot", "max_target", "max_est", "max_video").join(items, "utt")
    part = lambda m: F.struct(
        F.lit(m).alias("modality"), F.col(f"{m}_start").alias("start"), F.least(F.col(f"{m}_keep"), padded[m]).alias("kept"),
        padded[m].cast("int").alias("size"), F.coalesce(f"{m}_len", F.lit(0)).alias("n"),
    )
    return both.select("utt", "batch", "slot", F.inline(F.array(*map(part, MODALITIES))))


def training_rows(rows: DataFrame, plan: DataFrame, fillers: dict[str, Column]) -> DataFrame:
    """``utt, batch, slot, modality, t, x, padded`` of every padded batch.

    ``fillers`` is the vector that fills up a modality. ``plan`` is what
    :func:`batch_plan` gives, stored: the kept rows and the padding read it.
    """
    keys = ["utt", "modality"]
    near = attach_stats(rows, plan.where("kept > 0"), keys, n="n")
    at = F.col("t") - F.col("start")
    kept = near.where((at >= 0) & (at < F.col("kept"))).select(
        "utt", "batch", "slot", "modality", at.cast("int").alias("t"), "x", F.lit(False).alias("padded")
    )
    rest = plan.where("kept < size").withColumn("t", F.explode_outer(F.sequence("kept", F.col("size") - 1)))
    filler = reduce(lambda made, m: made.when(F.col("modality") == m, fillers[m]), MODALITIES, F)
    return kept.unionByName(rest.select("utt", "batch", "slot", "modality", F.col("t").cast("int").alias("t"), filler.alias("x"), F.lit(True).alias("padded")))


def vector_of(table: DataFrame, index: str, value: str) -> Column:
    """A bounded table (index, value) as one vector, for use as a filler."""
    packed = F.sort_array(F.collect_list(F.struct(index, value)))
    return table.agg(F.transform(packed, lambda e: e[value])).scalar()
