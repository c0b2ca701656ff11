"""Signal features over the long view (keys, t, value).

All groups are a frame, a block of frames or a chunk of samples, never a whole
sequence, so the work spreads however long one sequence is.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, LongType, StructField, StructType

from speechlake.functions import dsp
from speechlake.operators.chunks import CHUNK, attach_stats, chunk_window, own_rows, spread, with_halo

FRAME, HOP, BINS = 16, 6, 9


def lengths(signal: DataFrame, keys: list[str]) -> DataFrame:
    return signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))


def center(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Subtract the mean of every sequence."""
    stats = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.avg("value").alias("_mean"))
    joined = attach_stats(signal, stats, keys, n="_n")
    return joined.withColumn("value", F.col("value") - F.col("_mean")).drop("_n", "_mean")


def _box(column: str, window) -> Column:
    """Nine-tap mean that counts missing neighbours as zero."""
    return F.sum(column).over(window.rangeBetween(-4, 4)) / 9


def double_average(signal: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """Add ``smooth``: the nine-tap box filter applied twice."""
    haloed = with_halo(signal, before=8, after=8, size=size)
    w = chunk_window(keys)
    return own_rows(haloed.withColumn("_once", _box("value", w)).withColumn("smooth", _box("_once", w))).drop("_once")


def with_frames(df: DataFrame, length: int, hop: int, t: str = "t") -> DataFrame:
    """One row per sample and frame it belongs to; adds ``frame`` and ``pos``."""
    first = F.greatest(F.lit(0), F.ceil((F.col(t) - length + 1) / F.lit(hop))).cast("int")
    last = F.floor(F.col(t) / F.lit(hop)).cast("int")
    # With a hop beyond the frame length some samples lie between two frames.
    hit = df if hop <= length else df.where(first <= last)
    return hit.withColumn("frame", F.explode(F.sequence(first, last))).withColumn(
        "pos", (F.col(t) - F.col("frame") * hop).cast("int")
    )


def frames(signal: DataFrame, keys: list[str], length: int = FRAME, hop: int = HOP) -> DataFrame:
    """Overlapping full frames."""
    joined = attach_stats(signal, lengths(signal, keys).withColumnRenamed("n", "_n"), keys, n="_n")
    full = F.floor((F.col("_n") - length) / F.lit(hop)) + 1
    return with_frames(joined, length, hop).where(F.col("frame") < full).drop("_n")


def _basis(kind, k: int) -> Column:
    table = dsp.hann(FRAME) * kind(2 * np.pi * k * np.arange(FRAME) / FRAME)
    return F.get(F.lit([float(v) for v in table]), F.col("pos"))


def spectrum_columns() -> list[Column]:
    """Magnitude of every bin as an aggregate over the samples of a frame."""
    made = []
    for k in range(BINS):
        re, im = F.sum(F.col("value") * _basis(np.cos, k)), F.sum(F.col("value") * _basis(np.sin, k))
        made.append(F.sqrt(re * re + im * im).alias(f"s{k}"))
    return made


def short_time_spectrum(signal: DataFrame, keys: list[str]) -> DataFrame:
    """Magnitudes s0..s8 of Hann-windowed 16-sample frames."""
    framed = with_frames(signal, FRAME, HOP)
    grouped = framed.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_c"), *spectrum_columns())
    return grouped.where(F.col("_c") == FRAME).drop("_c")


STATS = ["w_mean", "w_rms", "r_rms", "p_zcr", "r_mean"]


def frame_features(signal: DataFrame, keys: list[str], size: int = CHUNK) -> DataFrame:
    """Five statistics and nine spectrum bins of every full frame of a centred signal.

    One shuffle brings a chunk together for the smoothing; the frames are then
    grouped with map-side partial sums.
    """
    haloed = with_halo(center(signal, keys), before=9, after=8, size=size)
    w = chunk_window(keys)
    smooth = haloed.withColumn("_once", _box("value", w)).withColumn("w", _box("_once", w))
    negative = F.col("p") < -1e-10
    parts = smooth.withColumn("p", F.col("value") - F.col("w")).withColumn(
        "crossing", F.coalesce((negative != F.lag(negative).over(w)).cast("int"), F.lit(0))
    )
    framed = with_frames(own_rows(parts), FRAME, HOP)
    r = F.abs("p")
    stats = [
        F.avg("w").alias("w_mean"),
        F.sqrt(F.avg(F.col("w") * F.col("w"))).alias("w_rms"),
        F.sqrt(F.avg(F.col("p") * F.col("p"))).alias("r_rms"),
        F.avg(F.when(F.col("pos") > 0, F.col("crossing")).otherwise(0)).alias("p_zcr"),
        F.avg(r).alias("r_mean"),
    ]
    grouped = framed.groupBy(*keys, "frame").agg(F.count(F.lit(1)).alias("_c"), *stats, *spectrum_columns())
    return grouped.where(F.col("_c") == FRAME).drop("_c")


def feature_vectors(features: DataFrame, keys: list[str]) -> DataFrame:
    """Concatenate the channels of a frame, in channel order, to one vector."""
    names = [*STATS, *[f"s{k}" for k in range(BINS)]]
    packed = F.sort_array(F.collect_list(F.struct("ch", F.array(*names).alias("v"))))
    return features.groupBy(*keys, "frame").agg(F.flatten(F.transform(packed, lambda c: c["v"])).alias("x"))


def pick_channels(signal: DataFrame, channels: list[int]) -> DataFrame:
    """Keep the listed channels and renumber them in the listed order."""
    place = F.array_position(F.lit(channels), F.col("ch").cast("int")) - 1
    return signal.where(F.col("ch").isin(channels)).withColumn("ch", place.cast("int"))


# Log-mel ------------------------------------------------------------------------

BLOCK_FRAMES = 256


def log_mel(
    signal: DataFrame,
    keys: list[str],
    n_fft: int,
    n_mels: int,
    sr: float,
    hop: int,
    win: int,
    fmin: float,
    fmax: float,
    block: int = BLOCK_FRAMES,
) -> DataFrame:
    """Log-mel spectrogram: (keys, frame, mel array). Needs more samples than the padding.

    The reflected edges are copies of samples with a mirrored index. A block of
    frames is one array row, so Python sees batches of bounded rows.
    """
    pad = (n_fft - hop) // 2
    joined = attach_stats(signal, lengths(signal, keys).withColumnRenamed("n", "_n"), keys, n="_n")
    t, n = F.col("t"), F.col("_n")
    places = F.array_compact(
        F.array(
            t + pad,
            F.when((t >= 1) & (t <= pad), pad - t),
            F.when((t >= n - 1 - pad) & (t <= n - 2), 2 * (n - 1) - t + pad),
        )
    )
    long_enough = F.when(n > pad, F.col("value")).otherwise(F.raise_error(F.lit("a signal is not longer than its padding")).cast("double"))
    padded = joined.withColumn("value", long_enough).withColumn("u", F.explode(places)).withColumn(
        "_frames", F.floor((n + 2 * pad - n_fft) / F.lit(hop)) + 1
    )
    reach = block * hop
    first = F.greatest(F.floor((F.col("u") - n_fft + 1 + hop - 1) / F.lit(reach)), F.lit(0))
    last = F.least(F.floor(F.col("u") / F.lit(reach)), F.floor((F.col("_frames") - 1) / F.lit(block)))
    blocked = padded.where(first <= last).withColumn("_block", F.explode(F.sequence(first, last)))
    inside = (F.col("u") >= F.col("_block") * reach) & (F.col("u") < (F.col("_block") + 1) * reach + n_fft - hop)
    arrays = spread(blocked.where(inside), *keys, "_block").groupBy(*keys, "_block").agg(
        F.sort_array(F.collect_list(F.struct("u", "value"))).alias("_s")
    )

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def spectra(blocks: pd.Series) -> pd.Series:
        mel = dsp.mel_matrix(sr, n_fft, n_mels, fmin, fmax)
        return blocks.map(lambda x: list(dsp.log_mel_frames(np.asarray(x), n_fft, hop, win, mel)) if len(x) >= n_fft else [])

    rows = arrays.select(*keys, "_block", spectra(F.col("_s.value")).alias("_m"))
    return rows.select(*keys, "_block", F.posexplode("_m").alias("_f", "mel")).select(
        *keys, (F.col("_block") * block + F.col("_f")).cast("int").alias("frame"), "mel"
    )


def zero_output(mel: DataFrame) -> DataFrame:
    """Mean over all frames of a spectrogram, per mel band: the pad vector when made of silence."""
    return mel.select(F.posexplode("mel").alias("band", "x")).groupBy("band").agg(F.avg("x").alias("x"))


def log_compress(x: Column, clip: float = 1e-5, gain: float = 1.0) -> Column:
    return F.log(F.greatest(x, F.lit(clip)) * gain)


def log_expand(x: Column, gain: float = 1.0) -> Column:
    return F.exp(x) / gain


# Levels -------------------------------------------------------------------------


def normalize_volume(signal: DataFrame, keys: list[str], frame: int = 2048, hop: int = 512) -> DataFrame:
    """Scale the loudest frame to 0.2; what then peaks above 1 is scaled to 1.

    Frames are centred on their sample: half a frame of zeros on both sides.
    """
    size = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("value")).alias("_peak"))
    shifted = attach_stats(signal, size, keys, n="_n").withColumn("_u", F.col("t") + frame // 2)
    framed = with_frames(shifted, frame, hop, "_u").where(F.col("frame") <= F.floor(F.col("_n") / F.lit(hop)))
    power = framed.groupBy(*keys, "frame").agg(
        (F.sum(F.col("value") * F.col("value")) / frame).alias("power"),
        F.max("_n").alias("_n"),
        F.max("_peak").alias("_peak"),
    )
    loud = power.groupBy(*keys).agg(
        F.max("_n").alias("_n"), F.max("_peak").alias("_peak"), (F.sqrt(F.max("power")) + 0.01).alias("_rms")
    )
    gain = F.lit(0.2) / F.col("_rms")
    gain = F.when(F.col("_peak") * gain > 1, 1 / F.col("_peak")).otherwise(gain)
    joined = attach_stats(signal, loud.select(*keys, "_n", gain.alias("_gain")), keys, n="_n")
    return joined.withColumn("value", F.col("value") * F.col("_gain")).drop("_n", "_gain")


def normalize_peak(signal: DataFrame, keys: list[str], level: float = 0.95) -> DataFrame:
    """Scale the peak to ``level``; an all-zero sequence stays zero."""
    peak = signal.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"), F.max(F.abs("value")).alias("_peak"))
    joined = attach_stats(signal, peak, keys, n="_n")
    scaled = F.coalesce(F.col("value") / F.nullif(F.col("_peak"), F.lit(0.0)), F.lit(0.0)) * level
    return joined.withColumn("value", scaled).drop("_n", "_peak")


def to_pcm(x: Column) -> Column:
    """16-bit sample, truncated and kept inside the range."""
    return F.greatest(F.least((x * 32768).cast("int"), F.lit(32767)), F.lit(-32768)).cast("short")


def from_pcm(x: Column) -> Column:
    return x / F.lit(32768.0)


def soft_clip(x: Column, scale: float = 20.0, limit: float = 50.0) -> Column:
    return limit * F.tanh(x / scale / limit)


# Conditioning -------------------------------------------------------------------

_OUTPUT = StructType([StructField("start", LongType()), StructField("y", ArrayType(DoubleType()))])


def _blocks(signal: DataFrame, keys: list[str], halo: int, size: int) -> DataFrame:
    """One array row per chunk: its samples with a halo, their place and the sequence length."""
    arrays = (
        spread(with_halo(signal, before=halo, after=halo, size=size), *keys, "chunk")
        .groupBy(*keys, "chunk")
        .agg(
            F.sort_array(F.collect_list(F.struct("t", "value"))).alias("_s"),
            F.min(F.when(F.col("own"), F.col("t"))).alias("_from"),
            F.count_if("own").alias("_count"),
        )
        .where("_count > 0")
    )
    per_chunk = lengths(signal, keys).withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("n") - 1) / F.lit(size))))
    )
    joined = arrays.join(per_chunk, [*keys, "chunk"])
    return joined.select(*keys, F.col("_s.value").alias("_x"), F.get("_s.t", F.lit(0)).alias("_t0"), "_from", "_count", "n")


def _run_blocks(blocks: DataFrame, keys: list[str], kernel) -> DataFrame:
    """Apply ``kernel(x, t0, start, count, n) -> (first index, values)`` to every block."""

    @F.pandas_udf(_OUTPUT)
    def run(x: pd.Series, t0: pd.Series, start: pd.Series, count: pd.Series, n: pd.Series) -> pd.DataFrame:
        made = [kernel(np.asarray(v, dtype=float), *map(int, at)) for v, *at in zip(x, t0, start, count, n)]
        return pd.DataFrame({"start": [m[0] for m in made], "y": [m[1] for m in made]})

    done = blocks.select(*keys, run("_x", "_t0", "_from", "_count", "n").alias("_o"))
    return done.select(*keys, "_o.start", F.posexplode("_o.y").alias("_i", "value")).select(
        *keys, (F.col("start") + F.col("_i")).cast("int").alias("t"), "value"
    )


def condition(
    signal: DataFrame,
    keys: list[str],
    fs: float = 250.0,
    mains: float = 60.0,
    harmonics: int = 2,
    q: float = 30.0,
    cut: float = 2.0,
    size: int = CHUNK,
) -> DataFrame:
    """Notch at the mains harmonics, then drift removal, both zero-phase.

    A chunk carries a halo as long as the filters remember: beyond it a state
    has faded below double precision, so cutting a long signal changes nothing.
    ``mains=0`` or ``cut=0`` leaves that filter out.
    """
    design = (fs, mains, harmonics, q, cut)

    def kernel(x, t0, start, count, n):
        return start, dsp.run_chain(x, design)[start - t0 : start - t0 + count]

    return _run_blocks(_blocks(signal, keys, dsp.chain_halo(design), size), keys, kernel)


def resample(signal: DataFrame, keys: list[str], new: float, old: float, size: int = CHUNK) -> DataFrame:
    """Polyphase resampling; the length is forced to round(N * new / old)."""
    up, down = dsp.rational_ratio(new, old)
    if float(new) == float(old):
        return signal.select(*keys, "t", "value")

    def kernel(x, t0, start, count, n):
        return dsp.polyphase_outputs(x, t0, start, count, n, up, down, round(n * (float(new) / float(old))))

    return _run_blocks(_blocks(signal, keys, dsp.polyphase_halo(up, down), size), keys, kernel)


def load_signal(
    signal: DataFrame, keys: list[str], frame_rate: float, fs: float = 250.0, per_frame: int = 4, size: int = CHUNK
) -> DataFrame:
    """Raw recording to model input: conditioned, resampled to four samples per frame, clipped.

    Both filters run on one block, so the samples are shuffled once.
    """
    new = float(frame_rate) * per_frame
    up, down = dsp.rational_ratio(new, fs)
    design = (fs, 60.0, 2, 30.0, 2.0)
    halo = dsp.chain_halo(design) + dsp.polyphase_halo(up, down)

    def kernel(x, t0, start, count, n):
        clean = dsp.run_chain(x, design)
        if new == fs:
            return start, clean[start - t0 : start - t0 + count]
        return dsp.polyphase_outputs(clean, t0, start, count, n, up, down, round(n * (new / fs)))

    made = _run_blocks(_blocks(signal, keys, halo, size), keys, kernel)
    return made.withColumn("value", soft_clip(F.col("value")))
