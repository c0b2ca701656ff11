"""Trims, alignment, gaps, cuts and augmentation over the long view (keys, t, value).

Per-sequence values reach the samples through :func:`attach_stats`, so no join or
window is keyed by the sequence alone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from speechlake.operators.chunks import CHUNK, attach_stats, chunk_of, chunk_window, own_rows, with_halo
from speechlake.operators.ordering import HOT_ROWS, dense_index, hash_order, hash_position, running_offset


def _sized(df: DataFrame, keys: list[str]) -> DataFrame:
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    return attach_stats(df, sizes, keys, n="_n")


def _steps(first: Column, last: Column) -> Column:
    """Integers first..last; empty when last < first."""
    return F.when(last >= first, F.sequence(first.cast("long"), last.cast("long"))).otherwise(F.array().cast("array<bigint>"))


# Trims --------------------------------------------------------------------------


def _window(df: DataFrame, left: Column, length: Column) -> DataFrame:
    t = F.col("t")
    return df.where((t >= left) & (t < left + length)).withColumn("t", (t - left).cast("int"))


def trim_edges(df: DataFrame, keys: list[str], left: int, right: int | None = None) -> DataFrame:
    """Drop samples at both ends; a sequence too short for that becomes empty."""
    left, right = max(left, 0), max(left if right is None else right, 0)
    return _window(_sized(df, keys), F.lit(left), F.col("_n") - left - right).drop("_n")


def center_trim(df: DataFrame, keys: list[str], targets: DataFrame, target: str) -> DataFrame:
    """Cut every sequence to its target length around the centre.

    ``targets`` has one row per key; the odd rest goes off the right end and
    shorter sequences stay as they are.
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    plan = sizes.join(targets.select(*keys, F.greatest(target, F.lit(0)).alias("_want")), keys)
    joined = attach_stats(df, plan, keys, n="_n")
    spare = F.greatest(F.col("_n") - F.col("_want"), F.lit(0))
    return _window(joined, F.floor(spare / F.lit(2)), F.col("_n") - spare).drop("_n", "_want")


def speech_per_video(frame_rate: float, video_fps: float) -> int | None:
    """Whole number of speech frames per video frame, if there is one."""
    nearest = round(frame_rate / video_fps)
    return nearest if nearest >= 1 and abs(frame_rate / video_fps - nearest) < 1e-6 else None


def alignment_targets(
    lengths: DataFrame, frame_rate: float, samples_per_frame: int = 4, video_fps: float = 25.0
) -> DataFrame:
    """Common lengths of the modalities of an utterance, in their own steps.

    Input columns: silent, speech_len, phone_len, emg_len, video_len (0 when
    missing), voiced_len (null unless silent). A voiced recording has one common
    length. A silent one aligns its signal with its video, and the voiced signal
    with speech and phones. Lengths are compared in speech frames; with a whole
    number k of speech frames per video frame they are cut to a multiple of k.
    """
    k = speech_per_video(frame_rate, video_fps)
    video = F.col("video_len")
    has_video = video > 0
    if k is None:
        video_frames = F.floor(video * F.lit(frame_rate) / F.lit(video_fps))
        to_video = lambda n: F.floor(n * F.lit(video_fps) / F.lit(frame_rate))
        whole = lambda n: n
    else:
        video_frames = video * k
        to_video = lambda n: F.floor(n / F.lit(k))
        whole = lambda n: F.when(has_video, F.floor(n / F.lit(k)) * k).otherwise(n)
    per_frame = lambda c: F.floor(F.col(c) / F.lit(samples_per_frame))
    with_video = F.when(has_video, video_frames)  # null is ignored by least
    voiced = whole(F.least("speech_len", "phone_len", per_frame("emg_len"), with_video))
    group_a = whole(F.least(per_frame("emg_len"), with_video))
    group_b = F.least("speech_len", "phone_len", F.coalesce(per_frame("voiced_len"), F.lit(0)))
    silent = F.col("silent")
    signal_side = F.when(silent, group_a).otherwise(voiced)
    speech_side = F.when(silent, group_b).otherwise(voiced)
    as_int = lambda c, name: c.cast("int").alias(name)
    return lengths.select(
        "*",
        as_int(speech_side, "speech_to"),
        as_int(speech_side, "phone_to"),
        as_int(signal_side * samples_per_frame, "emg_to"),
        as_int(F.when(silent, group_b * samples_per_frame), "voiced_to"),
        as_int(F.when(has_video, to_video(signal_side)).otherwise(video), "video_to"),
    )


def edge_steps(frame_rate: float, seconds: float = 0.2, samples_per_frame: int = 4, video_fps: float = 25.0) -> dict[str, int]:
    """Steps to cut at each end per modality.

    The signal is cut by the speech frames times the samples per frame, so the
    modalities stay in step also at rates that are no whole numbers.
    """
    frames = round(frame_rate * seconds)
    return {"speech": frames, "emg": frames * samples_per_frame, "video": round(video_fps * seconds)}


# Fixed cuts ---------------------------------------------------------------------


def fixed_length_chunks(
    df: DataFrame, key: str, length: int, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Concatenate all sequences in key order and cut them every ``length`` samples.

    Returns (piece, pos, value); the last piece is filled with zeros.
    """
    sizes = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    placed = running_offset(sizes, [], [F.col(key)], F.col(key), F.col("_n"), "_offset", hot_rows)
    flat = attach_stats(df, placed, [key], n="_n").select((F.col("_offset") + F.col("t")).alias("_at"), "value")
    total = F.col("_total")
    rest = F.pmod(total, F.lit(length))
    filled = F.when(rest == 0, total).otherwise(total + length - rest)
    padding = sizes.agg(F.coalesce(F.sum("_n"), F.lit(0)).alias("_total")).select(
        F.explode(_steps(total, filled - 1)).alias("_at"), F.lit(0.0).alias("value")
    )
    return flat.unionByName(padding).select(
        F.floor(F.col("_at") / F.lit(length)).alias("piece"), F.pmod("_at", F.lit(length)).cast("int").alias("pos"), "value"
    )


def split_by_lengths(
    flat: DataFrame, lengths: DataFrame, item: str, size: int = CHUNK, hot_rows: int = HOT_ROWS
) -> DataFrame:
    """Cut a flat sequence (at, value) into consecutive pieces of given lengths.

    Every piece leaves a marker at its start and at each chunk border inside it;
    within a chunk the last marker names the piece of a sample. That is linear in
    the samples, and a chunk holds at most ``size`` of them. What the lengths do
    not cover is left out; lengths that do not fit are an error.
    """
    placed = running_offset(lengths.where("length > 0"), [], [F.col(item)], F.col(item), F.col("length"), "_lo", hot_rows)
    have = flat.agg(F.count(F.lit(1))).scalar()
    end = F.col("_lo") + F.col("length")
    fits = F.when(end <= have, F.col("_lo")).otherwise(F.raise_error(F.lit("lengths exceed the sequence")))
    markers = (
        placed.withColumn("_lo", fits)
        .withColumn("_chunk", F.explode(F.sequence(chunk_of("_lo", size), chunk_of(end - 1, size))))
        .select(
            "_chunk",
            F.greatest("_lo", F.col("_chunk") * size).alias("at"),
            F.struct(F.col(item), F.col("_lo").alias("lo"), end.alias("hi")).alias("_piece"),
            F.lit(None).cast("double").alias("value"),
            F.lit(0).alias("_order"),
        )
    )
    rows = flat.select(
        chunk_of("at", size).alias("_chunk"), "at", F.lit(None).cast(markers.schema["_piece"].dataType).alias("_piece"),
        "value", F.lit(1).alias("_order"),
    )
    w = Window.partitionBy("_chunk").orderBy("at", "_order").rowsBetween(Window.unboundedPreceding, 0)
    named = rows.unionByName(markers).withColumn("_piece", F.last("_piece", ignorenulls=True).over(w))
    return named.where((F.col("_order") == 1) & (F.col("at") < F.col("_piece.hi"))).select(
        F.col(f"_piece.{item}").alias(item), (F.col("at") - F.col("_piece.lo")).cast("int").alias("t"), "value"
    )


def splice(chunks: DataFrame, keys: list[str], overlap: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Overlap-add of consecutive chunks (keys, seg, i, value) with linear ramps."""
    sizes = chunks.groupBy(*keys, "seg").agg(F.count(F.lit(1)).alias("_len"))
    checked = F.when(F.col("_len") >= overlap, F.col("_len") - overlap).otherwise(
        F.raise_error(F.lit("a chunk is shorter than the overlap"))
    )
    starts = running_offset(sizes, keys, [F.col("seg")], F.col("seg"), checked, "_start", hot_rows)
    joined = chunks.join(starts, [*keys, "seg"])
    i, from_end = F.col("i"), F.col("_len") - 1 - F.col("i")
    step = float(max(overlap - 1, 1))
    up = F.when(i < overlap, i / step).otherwise(1.0)
    # The falling ramp ends at 0; a ramp of one step is just its first value, 1.
    down = F.when(from_end < overlap, from_end / step).otherwise(1.0) if overlap > 1 else F.lit(1.0)
    return joined.groupBy(*keys, (F.col("_start") + i).alias("t")).agg(F.sum(F.col("value") * up * down).alias("value"))


# Gaps and smoothing --------------------------------------------------------------


def fill_gaps(df: DataFrame, keys: list[str], column: str = "value", size: int = CHUNK) -> DataFrame:
    """Linear interpolation between valid neighbours, edge values outside.

    Gaps may be longer than a chunk: a chunk passes on its first and last valid
    sample, and only those summaries meet per sequence. A sequence without any
    valid sample is dropped.
    """
    chunked = df.withColumn("chunk", chunk_of("t", size))
    valid = F.when(F.col(column).isNotNull(), F.struct(F.col("t").alias("t"), F.col(column).cast("double").alias("v")))
    across = Window.partitionBy(*keys).orderBy("chunk")
    carried = (
        chunked.groupBy(*keys, "chunk")
        .agg(F.min(valid).alias("_first"), F.max(valid).alias("_last"))
        .select(
            *keys,
            "chunk",
            F.last("_last", ignorenulls=True).over(across.rowsBetween(Window.unboundedPreceding, -1)).alias("_before"),
            F.first("_first", ignorenulls=True).over(across.rowsBetween(1, Window.unboundedFollowing)).alias("_after"),
        )
    )
    w = chunk_window(keys)
    near = chunked.join(carried, [*keys, "chunk"]).withColumns(
        {
            "_p": F.coalesce(F.last(valid, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)), "_before"),
            "_q": F.coalesce(F.first(valid, ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)), "_after"),
        }
    )
    share = (F.col("t") - F.col("_p.t")).cast("double") / F.nullif(F.col("_q.t") - F.col("_p.t"), F.lit(0))
    between = F.col("_p.v") + share * (F.col("_q.v") - F.col("_p.v"))
    made = F.coalesce(F.col(column).cast("double"), between, F.col("_p.v"), F.col("_q.v"))
    return near.withColumn(column, made).where(F.col(column).isNotNull()).drop("chunk", "_before", "_after", "_p", "_q")


def smooth_landmarks(points: DataFrame, keys: list[str], margin: int = 6, size: int = CHUNK) -> DataFrame:
    """Centred mean that shrinks at the ends, moved back to the frame's own centroid.

    ``points`` has (keys, t, point, x, y). A mean is a difference of two running
    sums inside a chunk. How far the end is shows in the rows that follow, so no
    length is joined; points and frames of a chunk share its one shuffle.
    """
    haloed = with_halo(points, before=margin + 1, after=margin, size=size).repartition(*keys, "chunk")
    line = chunk_window([*keys, "point"])
    summed = haloed.withColumns({f"_p{c}": F.sum(c).over(line.rowsBetween(Window.unboundedPreceding, 0)) for c in "xy"})
    m = F.least(F.lit(margin), F.col("t"), F.count("t").over(line.rowsBetween(1, margin))).cast("int")
    sized = summed.withColumn("_m", m)

    def mean(c: str) -> Column:
        high = F.coalesce(*(F.when(F.col("_m") == k, F.lead(f"_p{c}", k).over(line)) for k in range(margin + 1)))
        low = F.coalesce(*(F.when(F.col("_m") == k, F.lag(f"_p{c}", k + 1).over(line)) for k in range(margin + 1)), F.lit(0.0))
        return (high - low) / (2 * F.col("_m") + 1)

    smooth = own_rows(sized.withColumns({"_sx": mean("x"), "_sy": mean("y")}).withColumn("_chunk", F.col("chunk")))
    frame = Window.partitionBy(*keys, "_chunk", "t")
    moved = lambda c: F.col(f"_s{c}") + F.avg(c).over(frame) - F.avg(f"_s{c}").over(frame)
    return smooth.select(*keys, "t", "point", moved("x").alias("x"), moved("y").alias("y"))


def centre_bounds(points: DataFrame, keys: list[str], height: int, width: int, half: int) -> DataFrame:
    """Crop box around the mean point of every frame, clipped to the image."""
    centres = points.groupBy(*keys, "t").agg(F.avg("x").alias("cx"), F.avg("y").alias("cy"))
    clip = lambda c, limit: F.bround(F.greatest(F.lit(0.0), F.least(F.lit(float(limit)), c)), 0).cast("int")
    return centres.select(
        *keys, "t", "cx", "cy",
        clip(F.col("cx") - half, width).alias("x_min"), clip(F.col("cx") + half, width).alias("x_max"),
        clip(F.col("cy") - half, height).alias("y_min"), clip(F.col("cy") + half, height).alias("y_max"),
    )


def quarantine(boxes: DataFrame, keys: list[str], height: int, width: int, half: int, threshold: int = 5) -> DataFrame:
    """Keep only sequences whose centres all stay near the image centre."""
    off = (F.abs(F.col("cy") - height / 2) > half + threshold) | (F.abs(F.col("cx") - width / 2) > half + threshold)
    flags = boxes.groupBy(*keys).agg((F.max("t") + 1).alias("_n"), F.bool_or(off).alias("_off"))
    return attach_stats(boxes, flags, keys, n="_n").where(~F.col("_off")).drop("_n", "_off")


def with_modality(df: DataFrame, lengths: DataFrame, keys: list[str], length: str) -> DataFrame:
    """Samples of the sequences that have the other modality (length above 0)."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    kept = sizes.join(lengths.where(F.col(length) > 0).select(*keys), keys, "left_semi")
    return attach_stats(df, kept, keys, n="_n").drop("_n")


# Augmentation --------------------------------------------------------------------


def _uniform(seed: int, *cols: str | Column) -> Column:
    """Reproducible number in [0, 2**32) from a seed and a key."""
    return hash_position(hash_order(seed, *cols))


def time_shift(df: DataFrame, keys: list[str], batch: Column, seed: int, steps: int = 8) -> DataFrame:
    """Shift left by 0 to steps-1 samples, the same for a batch; the tail becomes zero."""
    shift = F.pmod(_uniform(seed, batch), F.lit(steps)).cast("int")
    t, n, r = F.col("t"), F.col("_n"), F.col("_r")
    place = lambda at, v: F.struct(at.cast("int").alias("t"), v.alias("value"))
    made = F.array_compact(
        F.array(
            F.when(t >= r, place(t - r, F.col("value"))),
            F.when(t >= n - r, place(t, F.lit(0.0))),
        )
    )
    return _sized(df, keys).withColumn("_r", F.least(shift, F.col("_n"))).select(*keys, F.inline(made))


def drop_channels(df: DataFrame, batch: Column, seed: int, probability: float) -> DataFrame:
    """Zero whole channels of a batch with the given probability."""
    dropped = _uniform(seed, batch, "ch") < F.lit(int(probability * 2**32))
    return df.withColumn("value", F.when(dropped, F.lit(0.0)).otherwise(F.col("value")))


def permute_channels(df: DataFrame, keys: list[str], channels: list[int], seed: int, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Shuffle the samples of the listed channels in time: a sample moves to its hash rank."""
    chosen = F.col("ch").isin(channels)
    hashed = df.where(chosen).withColumn("_digest", hash_order(seed, *keys, "t"))
    moved = dense_index(
        hashed.drop("t"), keys, [F.col("_digest")], hash_position(F.col("_digest")), "t", hot_rows,
    )
    moved = moved.withColumn("t", F.col("t").cast("int"))
    return moved.select(*df.columns).unionByName(df.where(~chosen))


def random_segment(df: DataFrame, keys: list[str], length: int, seed: int) -> DataFrame:
    """A segment of exactly ``length`` samples at a random start; short sequences get zeros."""
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    room = F.greatest(F.col("_n") - length + 1, F.lit(1))
    cut = _window(attach_stats(df, sizes, keys, n="_n"), F.pmod(_uniform(seed, *keys), room), F.lit(length))
    padding = sizes.select(
        *keys, F.explode(_steps(F.col("_n"), F.lit(length - 1))).alias("t"), F.lit(0.0).alias("value")
    ).withColumn("t", F.col("t").cast("int"))
    return cut.select(*keys, "t", "value").unionByName(padding)


def paired_segment(
    features: DataFrame, audio: DataFrame, keys: list[str], length: int, hop: int, seed: int
) -> tuple[DataFrame, DataFrame]:
    """The same random stretch of a feature sequence and of its audio."""
    per_segment = math.ceil(length / hop)
    sizes = features.groupBy(*keys).agg(F.count(F.lit(1)).alias("_f"))
    audio_sizes = audio.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    room = F.greatest(F.col("_f") - per_segment, F.lit(1))
    start = F.when(F.col("_n") >= length, F.pmod(_uniform(seed, *keys), room)).otherwise(0)
    plan = sizes.join(audio_sizes, keys).withColumn("_start", start)

    def cut(df: DataFrame, size: str, scale: int, steps: int) -> DataFrame:
        kept = _window(attach_stats(df, plan, keys, n=size), F.col("_start") * scale, F.lit(steps))
        have = F.least(F.col(size) - F.col("_start") * scale, F.lit(steps))
        padding = plan.select(*keys, F.explode(_steps(have, F.lit(steps - 1))).alias("t"), F.lit(0.0).alias("value"))
        return kept.select(*keys, "t", "value").unionByName(padding.withColumn("t", F.col("t").cast("int")))

    return cut(features, "_f", 1, per_segment), cut(audio, "_n", hop, per_segment * hop)


def repeat_upsample(df: DataFrame, keys: list[str], k: int, targets: DataFrame, target: str, valid: str) -> DataFrame:
    """Repeat every frame k times, cut or fill to the target length, zero masked frames.

    ``targets`` has per key the target length and the number of valid frames.
    Returns (keys, t, value, masked).
    """
    sizes = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    plan = sizes.join(targets.select(*keys, F.col(target).alias("_to"), F.col(valid).alias("_valid")), keys)
    masked = F.col("t") >= F.col("_valid")
    repeated = (
        attach_stats(df, plan, keys, n="_n")
        .withColumns({"masked": masked, "value": F.when(masked, F.lit(0.0)).otherwise(F.col("value"))})
        .withColumn("_j", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
        .withColumn("t", (F.col("t") * k + F.col("_j")).cast("int"))
        .where(F.col("t") < F.col("_to"))
        .select(*keys, "t", "value", "masked")
    )
    padding = plan.select(*keys, F.explode(_steps(F.col("_n") * k, F.col("_to") - 1)).alias("t"))
    return repeated.unionByName(
        padding.select(*keys, F.col("t").cast("int").alias("t"), F.lit(0.0).alias("value"), F.lit(True).alias("masked"))
    )
