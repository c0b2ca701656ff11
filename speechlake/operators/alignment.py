"""Frame alignment of predicted and target sequences.

Pairs are independent rows that hold two whole sequences; the caller bounds
their length, as batches do, and so the size of a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions import arrays, warp
from speechlake.operators.chunks import spread


def sequence_arrays(frames: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """One row per sequence: its frames (key, t, …) as arrays in order."""
    packed = F.sort_array(F.collect_list(F.struct("t", *columns)))
    return frames.groupBy(key).agg(packed.alias("_s")).select(key, *[F.col(f"_s.{c}").alias(c) for c in columns])


def aligned_distance(pred: DataFrame, target: DataFrame, keys: list[str], feature: str = "feat") -> DataFrame:
    """Distance of frames with the same index; the eps is added to every difference."""
    p = pred.select(*keys, F.col(feature).alias("_p"))
    y = target.select(*keys, F.col(feature).alias("_y"))
    return p.join(y, keys).select(*keys, arrays.distance(F.col("_y"), F.col("_p"), 1e-6).alias("dist"))


def gather(pred: DataFrame, matches: DataFrame, keys: list[str]) -> DataFrame:
    """Predicted rows at the matched index: matches (keys, t, pred_t) ⋈ pred (keys, t, …)."""
    renamed = pred.withColumnRenamed("t", "pred_t")
    return matches.join(renamed, [*keys, "pred_t"])


def align_pairs(
    pairs: DataFrame, phone_weight: float, noise: int | None, dimension_norm: bool = False, dim: int = 1
) -> DataFrame:
    """Add ``alignment``: the predicted frame for every target frame.

    Input columns: silent, feat and scores (predicted), y and phones (target).
    Silent pairs are warped; voiced pairs match frame by frame and must be
    equally long. Voiced pairs reach the warping as nulls.
    """
    scale = float(dim) ** 0.5 if dimension_norm else 1.0
    n, silent = F.size("y"), F.col("silent")
    align = warp.align_frames(phone_weight, noise, scale)
    warped = pairs.withColumn("_w", align(*(F.when(silent, F.col(c)) for c in ("feat", "scores", "y", "phones"))))
    # The condition stands before the error, so no plan can raise it for a silent pair.
    same = F.when(silent, F.lit(None)).when(F.size("feat") == n, F.sequence(F.lit(0), n - 1)).otherwise(
        F.raise_error(F.lit("voiced prediction and target differ in length"))
    )
    return warped.withColumn("alignment", F.when(silent, F.col("_w")).otherwise(same)).drop("_w")


def aligned_frames(aligned: DataFrame, keys: list[str], noise: int | None) -> DataFrame:
    """One row per target frame with its distance, nll, predicted and target phone."""
    # The matched frames are gathered per pair, so a row that leaves holds one of each.
    feat, scores = F.col("feat"), F.col("scores")
    matched = F.transform("alignment", lambda i: F.struct(F.get(feat, i).alias("feat"), F.get(scores, i).alias("scores")))
    gathered = aligned.select(*keys, "silent", F.arrays_zip("y", "phones", "alignment", matched.alias("m")).alias("_z"))
    # The inner form would make the planner test the size below, on a copy of the whole expression.
    rows = gathered.select(*keys, "silent", F.posexplode_outer("_z").alias("t", "f")).where("t IS NOT NULL")
    eps = F.when(F.col("silent"), 0.0).otherwise(1e-6)
    gaps = F.zip_with(F.col("f.y"), F.col("f.m.feat"), lambda y, p: y - p)
    dist = F.sqrt(F.aggregate(gaps, F.lit(0.0), lambda s, g: s + (g + eps) * (g + eps)))
    nll = arrays.cross_entropy(F.col("f.m.scores"), F.col("f.phones"))
    valid = F.lit(True) if noise is None else F.col("f.phones") != noise
    return rows.select(
        *keys, "silent", "t", F.col("f.alignment").alias("pred_t"), dist.alias("dist"),
        nll.alias("nll"),
        arrays.argmax(F.col("f.m.scores")).alias("pred"), F.col("f.phones").alias("target"), valid.alias("valid"),
    )


def pair_scores(frames: DataFrame, keys: list[str], phone_weight: float) -> DataFrame:
    """Summed cost, distance and phone loss of every pair (distance and weight unscaled)."""
    nll = F.when(F.col("valid"), F.col("nll")).otherwise(0.0)
    return frames.groupBy(*keys).agg(
        F.sum(F.col("dist") * 0.5 + phone_weight * nll).alias("cost"),
        F.sum("dist").alias("dist"),
        F.sum(nll).alias("nll"),
        F.count(F.lit(1)).alias("frames"),
    )


def apply_per_channel(df: DataFrame, fn, keys: list[str], schema: str) -> DataFrame:
    """Extension point: a pandas function per (keys, ch) group.

    Groups must be bounded; add a chunk to the keys for long signals. Sorted
    groups are cut from whole batches, as a batch of its own for each would cost
    far more than a small group's work. A task holds a batch and a group.
    """
    by = [*keys, "ch"]

    def groups(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held: list[pd.DataFrame] = []
        last = None
        for batch in batches:
            if not len(batch):
                continue
            codes = [pd.factorize(batch[k], use_na_sentinel=False)[0] for k in by]
            cuts = np.flatnonzero(np.any([np.diff(c) != 0 for c in codes], axis=0)) + 1
            starts = [0, *cuts.tolist(), len(batch)]
            first = [None if pd.isna(v) else v for v in batch.loc[batch.index[0], by].tolist()]
            made = []
            if held and first != last:
                made.append(fn(pd.concat(held, ignore_index=True)))
                held = []
            for start, end in zip(starts, starts[1:]):
                part = batch.iloc[start:end].reset_index(drop=True)
                if end == len(batch):
                    held.append(part)
                elif held:
                    made.append(fn(pd.concat([*held, part], ignore_index=True)))
                    held = []
                else:
                    made.append(fn(part))
            last = [None if pd.isna(v) else v for v in batch.loc[batch.index[-1], by].tolist()]
            made = [m for m in made if len(m)]
            if made:
                yield pd.concat(made, ignore_index=True)
        if held:
            yield fn(pd.concat(held, ignore_index=True))

    return spread(df, *by).sortWithinPartitions(*by).mapInPandas(groups, schema)


def score_pairs(df: DataFrame, fn, keys: list[str], schema: str) -> DataFrame:
    """Extension point: a pandas scorer per pair."""
    return df.groupBy(*keys).applyInPandas(fn, schema)
