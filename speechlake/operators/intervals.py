"""Annotation tiers as interval tables.

Columns: utt, tier, idx (0-based place in its tier), xmin, xmax, label. A tier
without intervals may be present as one row with a null idx.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions.text import phone_label
from speechlake.operators.chunks import CHUNK, spread
from speechlake.sources.scratch import stored

EPS = 1e-9
# Frames of one partition of a label grid.
FRAMES = 1 << 19
SILENT_LABELS = ["", "spn", "sil"]


def normalize_labels(intervals: DataFrame, noise_known: bool = False) -> DataFrame:
    return intervals.withColumn("label", phone_label(F.col("label"), noise_known))


def unknown_labels(intervals: DataFrame, inventory: DataFrame) -> DataFrame:
    """Labels that are not in the inventory (phone_id, phone)."""
    labels = intervals.select("label").distinct()
    return labels.join(inventory, labels["label"] == inventory["phone"], "left_anti")


def frame_grid(sizes: DataFrame, keys: list[str], n: str, chunk: int = CHUNK) -> DataFrame:
    """Rows 0..n-1 per key; long grids are cut into chunks that are spread before they grow."""
    last = F.floor((F.col(n) - 1) / F.lit(chunk))
    starts = sizes.where(F.col(n) > 0).withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    spread = starts.repartition(*keys, "_c")
    end = F.least(F.col(n).cast("long"), (F.col("_c") + 1) * chunk) - 1
    frames = spread.withColumn("frame", F.explode(F.sequence(F.col("_c") * chunk, end)))
    return frames.withColumn("frame", F.col("frame").cast("int")).drop("_c")


def frame_labels(
    intervals: DataFrame, tier: str, frame_rate: float, lengths: DataFrame | None = None, length: str = "n", silence: str = "sil"
) -> DataFrame:
    """Label of every frame: the last interval that covers it, silence elsewhere.

    An interval covers the frames from floor(xmin * rate) up to, not including,
    floor(xmax * rate). The grid ends with the frame of the last interval's end,
    or is cut or filled to the given length per utterance. Intervals and grid
    meet in one aggregation per (utt, frame), so there is no range join. Its
    sorts are as many as the frames call for, so a task holds ``FRAMES`` or so.
    """
    rows = intervals.where(F.col("tier") == tier)
    scale = lambda c: (F.col(c) * F.lit(float(frame_rate))).cast("long")
    span = F.greatest(scale("xmax") - scale("xmin"), F.lit(0))
    sizes = rows.groupBy("utt").agg((F.max_by(scale("xmax"), "idx") + 1).alias("_size"), F.sum(span).alias("_covered"))
    sizes = sizes.withColumn("_n", F.col("_size")) if lengths is None else sizes.join(
        lengths.select("utt", F.col(length).alias("_n")), "utt"
    )
    sizes = stored(sizes, "frame-sizes")
    frames = sizes.agg(F.sum(F.coalesce("_n", F.lit(0)) + F.coalesce("_covered", F.lit(0)))).first()[0] or 0
    grid = frame_grid(sizes, ["utt"], "_n").select(
        "utt", "frame", (F.col("frame") < F.col("_size")).alias("inside"), F.lit(-1).alias("idx"), F.lit(silence).alias("label")
    )
    covered = (
        rows.withColumns({"_lo": scale("xmin"), "_hi": scale("xmax")})
        .where("_lo < _hi")
        .withColumn("frame", F.explode(F.sequence("_lo", F.col("_hi") - 1)))
        .select("utt", F.col("frame").cast("int").alias("frame"), F.lit(None).cast("boolean").alias("inside"), "idx", "label")
    )
    merged = spread(covered.unionByName(grid), "utt", "frame", least=-(-frames // FRAMES)).groupBy("utt", "frame").agg(
        F.max("inside").alias("inside"), F.max_by("label", "idx").alias("label")
    )
    return merged.where(F.col("inside").isNotNull()).select(
        "utt", "frame", F.when(F.col("inside"), F.col("label")).otherwise(F.lit(silence)).alias("label")
    )


def last_interval_report(
    intervals: DataFrame, tier: str = "phones", fixed: float = 0.3, minimum: float = 0.3, silence: list[str] | None = None
) -> DataFrame:
    """Whether the last interval of a tier has to be cut, with the reason, per utterance."""
    silence = [""] if silence is None else silence
    in_tier = F.col("tier") == tier
    place = F.struct("idx", "xmin", "xmax", "label")
    last = intervals.groupBy("utt").agg(
        F.bool_or(in_tier).alias("_has"), F.max(F.when(in_tier & F.col("idx").isNotNull(), place)).alias("_last")
    )
    start, end, label = F.col("_last.xmin"), F.col("_last.xmax"), F.col("_last.label")
    duration = end - start
    new_end = F.least(start + fixed, end)
    fixed_note = F.concat(
        F.lit("fixed_last:"), label, F.lit(", old_dur="), F.format_string("%.6f", duration),
        F.lit(", rem="), F.format_string("%.6f", end - new_end),
    )
    reason = (
        F.when(~F.col("_has"), f"missing_tier:{tier}")
        .when(F.col("_last").isNull(), "empty_intervals")
        .when(label.isin(silence), "already_ends_with_silence")
        .when(duration + EPS < minimum, f"last_dur<{minimum}")
        .when(duration <= fixed + EPS, f"last_dur<=fixed_dur({fixed})")
        .otherwise(fixed_note)
    )
    return last.select(
        "utt", F.lit(tier).alias("tier"), F.col("_last.idx").alias("idx"), new_end.alias("new_end"), end.alias("old_end"),
        reason.startswith("fixed_last:").alias("changed"), reason.alias("reason"),
    )


def repair_last_intervals(intervals: DataFrame, report: DataFrame, label: str = "") -> DataFrame:
    """Cut the reported intervals and append a silence interval for the rest."""
    cut = report.where("changed").select("utt", "tier", "idx", "new_end", "old_end")
    joined = intervals.join(cut, ["utt", "tier", "idx"], "left")
    row = lambda idx, lo, hi, text: F.struct(
        idx.cast("int").alias("idx"), lo.alias("xmin"), hi.alias("xmax"), text.alias("label")
    )
    idx, lo, hi, text = (F.col(c) for c in ("idx", "xmin", "xmax", "label"))
    new_end, old_end = F.col("new_end"), F.col("old_end")
    made = (
        F.when(new_end.isNull(), F.array(row(idx, lo, hi, text)))
        .when(old_end - new_end > EPS, F.array(row(idx, lo, new_end, text), row(idx + 1, new_end, old_end, F.lit(label))))
        .otherwise(F.array(row(idx, lo, new_end, text)))
    )
    return joined.select("utt", "tier", F.inline(made))


def has_label(intervals: DataFrame, tier: str, label: str) -> DataFrame:
    """(utt, found): whether the tier contains the label."""
    return intervals.groupBy("utt").agg(
        F.coalesce(F.bool_or((F.col("tier") == tier) & (F.col("label") == label)), F.lit(False)).alias("found")
    )


def inventory(intervals: DataFrame, tier: str, excluded: list[str] | None = None) -> DataFrame:
    """Distinct labels of a tier without silence and noise."""
    left_out = SILENT_LABELS if excluded is None else excluded
    return (
        intervals.where((F.col("tier") == tier) & ~F.col("label").isin(left_out)).select(F.col("label").alias("phone")).distinct()
    )


def grid_number(path: Column) -> Column:
    """Number in the name of an annotation file: four digits, more from 10000 on."""
    return F.regexp_extract(path, r"tg_(\d{4,})\.TextGrid", 1).try_cast("long")


def reprocess_report(files: DataFrame, before: DataFrame, after: DataFrame) -> DataFrame:
    """Outcome per annotation file (utt, path) given the noise flags before and after a rerun.

    Clean files are skipped; noisy ones are fixed when the rerun is clean, and
    failed when it is not, is missing or the file name has no number.
    """
    flags = files.join(before.select("utt", F.col("found").alias("noisy")), "utt", "left").join(
        after.select("utt", F.col("found").alias("still")), "utt", "left"
    )
    clean = ~F.coalesce("noisy", F.lit(False))
    fixed = grid_number(F.col("path")).isNotNull() & ~F.coalesce("still", F.lit(True))
    return flags.select("utt", F.when(clean, "skipped").when(fixed, "fixed").otherwise("failed").alias("status"))
