"""Signal feature queries."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from speechlake.functions import dsp
from speechlake.operators import signals as s
from speechlake.plans.corpus import SIGNAL_SQL, signal
from speechlake.plans.registry import query

KEYS = ["utt", "ch"]
MEL = {"n_fft": 16, "n_mels": 4, "sr": 250.0, "hop": 4, "win": 16, "fmin": 0.0, "fmax": 125.0}
NEW_RATE, OLD_RATE = 400.0, 250.0


def _nudge(digits: int) -> float:
    """Moves exact halves, which decimal inputs do produce, off the rounding border."""
    return 0.0123456789 * 10.0**-digits


def r(column: str, digits: int = 6):
    """Rounded for comparison; adding zero turns a negative zero into zero."""
    return (F.round(F.col(column) + F.lit(_nudge(digits)), digits) + F.lit(0.0)).alias(column)


def rsql(x: str, name: str, digits: int = 6) -> str:
    return f"round({x} + {_nudge(digits)!r}::DOUBLE, {digits}) + 0.0::DOUBLE AS {name}"


def _list(values) -> str:
    return "[" + ", ".join(f"{float(v)!r}::DOUBLE" for v in values) + "]"


@query("center_w1", f"WITH {SIGNAL_SQL} SELECT utt, ch, t, {rsql('value - avg(value) OVER (PARTITION BY utt, ch)', 'value', 9)} FROM signal")
def center(spark, sf_dir):
    return s.center(signal(spark, sf_dir), KEYS).select(*KEYS, "t", r("value", 9))


_BOX = "OVER (PARTITION BY utt, ch ORDER BY t ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) / 9"
SMOOTH_SQL = f"""{SIGNAL_SQL}, once AS (SELECT *, sum(value) {_BOX} AS o FROM signal),
  twice AS (SELECT *, sum(o) {_BOX} AS smooth FROM once)"""


@query("double_average_w2", f"WITH {SMOOTH_SQL} SELECT utt, ch, t, {rsql('smooth', 'smooth')} FROM twice")
def double_average(spark, sf_dir):
    return s.double_average(signal(spark, sf_dir), KEYS).select(*KEYS, "t", r("smooth"))


def _frames_sql(source: str, length: int = 16, hop: int = 6) -> str:
    return f"""starts AS (SELECT utt, ch, unnest(range(0, (n - {length}) // {hop} + 1))::INT AS frame
      FROM (SELECT utt, ch, count(*) AS n FROM {source} GROUP BY 1, 2) WHERE n >= {length}),
    framed AS (SELECT x.*, f.frame, x.t - f.frame * {hop} AS pos FROM starts f
      JOIN {source} x ON x.utt = f.utt AND x.ch = f.ch AND x.t >= f.frame * {hop} AND x.t < f.frame * {hop} + {length})"""


@query("frames_w3", f"WITH {SIGNAL_SQL}, {_frames_sql('signal')} SELECT utt, ch, frame, CAST(pos AS INT) AS pos, value FROM framed")
def frames(spark, sf_dir):
    return s.frames(signal(spark, sf_dir), KEYS).select(*KEYS, "frame", "pos", "value")


CENTERED_SQL = f"""{SIGNAL_SQL}, centered AS (SELECT utt, ch, t, value - avg(value) OVER (PARTITION BY utt, ch) AS value FROM signal)"""
PARTS_SQL = f"""{CENTERED_SQL}, once AS (SELECT *, sum(value) {_BOX} AS o FROM centered),
  twice AS (SELECT *, sum(o) {_BOX} AS w FROM once),
  detail AS (SELECT *, value - w AS p, abs(value - w) AS a FROM twice),
  parts AS (SELECT *, coalesce(((p < -1e-10) <> lag(p < -1e-10) OVER (PARTITION BY utt, ch ORDER BY t))::INT, 0) AS crossing FROM detail),
  {_frames_sql('parts')},
  stats AS (SELECT utt, ch, frame, avg(w) AS w_mean, sqrt(avg(w * w)) AS w_rms, sqrt(avg(p * p)) AS r_rms,
    avg(CASE WHEN pos > 0 THEN crossing ELSE 0 END) AS p_zcr, avg(a) AS r_mean FROM framed GROUP BY 1, 2, 3)"""


@query(
    "frame_stats_w4",
    f"WITH {PARTS_SQL} SELECT utt, ch, frame, {', '.join(rsql(c, c) for c in s.STATS)} FROM stats",
)
def frame_stats(spark, sf_dir):
    return s.frame_features(signal(spark, sf_dir), KEYS).select(*KEYS, "frame", *[r(c) for c in s.STATS])


def _dft_sql(source: str, n: int, bins: int) -> str:
    window = dsp.hann(n)
    k, m = np.meshgrid(np.arange(bins), np.arange(n), indexing="ij")
    cos, sin = (np.asarray(window * f(2 * np.pi * k * m / n)).ravel() for f in (np.cos, np.sin))
    return f"""spectrum AS (SELECT utt, ch, frame, bin::INT AS bin,
      sum(value * ({_list(cos)})[bin * {n} + pos + 1]) AS re, sum(value * ({_list(sin)})[bin * {n} + pos + 1]) AS im
    FROM {source}, (SELECT unnest(range({bins})) AS bin) GROUP BY 1, 2, 3, 4)"""


@query(
    "short_time_spectrum_w5",
    f"""WITH {CENTERED_SQL}, {_frames_sql('centered')}, {_dft_sql('framed', 16, 9)}
    SELECT utt, ch, frame, bin, {rsql('sqrt(re * re + im * im)', 'magnitude', 4)} FROM spectrum""",
)
def short_time_spectrum(spark, sf_dir):
    made = s.short_time_spectrum(s.center(signal(spark, sf_dir), KEYS), KEYS)
    bins = F.array(*[F.col(f"s{k}") for k in range(s.BINS)])
    return made.select(*KEYS, "frame", F.posexplode(bins).alias("bin", "magnitude")).select(
        *KEYS, "frame", "bin", r("magnitude", 4)
    )


@query(
    "feature_vectors_w6",
    f"""WITH {PARTS_SQL}, {_dft_sql('framed', 16, 9)},
    long AS (
      SELECT utt, frame, ch * 14 + k AS dim, v AS x FROM (SELECT utt, frame, ch, unnest(range(5)) AS k,
        unnest([w_mean, w_rms, r_rms, p_zcr, r_mean]) AS v FROM stats)
      UNION ALL SELECT utt, frame, ch * 14 + 5 + bin, sqrt(re * re + im * im) FROM spectrum)
    SELECT utt, frame, CAST(dim AS INT) AS dim, {rsql('x', 'x')} FROM long""",
)
def feature_vectors(spark, sf_dir):
    vectors = s.feature_vectors(s.frame_features(signal(spark, sf_dir), KEYS), ["utt"])
    return vectors.select("utt", "frame", F.posexplode("x").alias("dim", "x")).select("utt", "frame", "dim", r("x"))


def _mel_sql(value: str) -> str:
    mel = dsp.mel_matrix(MEL["sr"], MEL["n_fft"], MEL["n_mels"], MEL["fmin"], MEL["fmax"])
    cells = ", ".join(f"({b}, {k}, {float(w)!r}::DOUBLE)" for b, row in enumerate(mel) for k, w in enumerate(row) if w > 0)
    return f"""{SIGNAL_SQL}, scaled AS (SELECT utt, ch, t, {value} AS value, count(*) OVER (PARTITION BY utt, ch) AS n FROM signal),
    padded AS (SELECT utt, ch, t + 6 AS t, value FROM scaled
      UNION ALL SELECT utt, ch, 6 - t, value FROM scaled WHERE t BETWEEN 1 AND 6
      UNION ALL SELECT utt, ch, 2 * (n - 1) - t + 6, value FROM scaled WHERE t BETWEEN n - 7 AND n - 2),
    {_frames_sql('padded', 16, 4)}, {_dft_sql('framed', 16, 9)},
    cells(band, bin, weight) AS (VALUES {cells}),
    mel AS (SELECT utt, ch, frame, c.band::INT AS band, ln(greatest(sum(c.weight * sqrt(re * re + im * im + 1e-9)), 1e-5)) AS x
      FROM spectrum s JOIN cells c ON c.bin = s.bin GROUP BY 1, 2, 3, 4)"""


@query("log_mel_w7", f"WITH {_mel_sql('value / 1000')} SELECT utt, ch, frame, band, {rsql('x', 'x', 5)} FROM mel")
def log_mel(spark, sf_dir):
    scaled = signal(spark, sf_dir).withColumn("value", F.col("value") / 1000)
    rows = s.log_mel(scaled, KEYS, **MEL).select(*KEYS, "frame", F.posexplode("mel").alias("band", "x"))
    return rows.select(*KEYS, "frame", "band", r("x", 5))


@query(
    "zero_output_a17",
    f"WITH {_mel_sql('value * 0')} SELECT band, {rsql('avg(x)', 'x', 5)} FROM mel GROUP BY 1",
)
def zero_output(spark, sf_dir):
    """The pad vector: the mean frame of silence."""
    silent = signal(spark, sf_dir).withColumn("value", F.col("value") * 0)
    return s.zero_output(s.log_mel(silent, KEYS, **MEL)).select("band", r("x", 5))


@query(
    "log_compression_w8",
    f"SELECT event_id, {rsql('ln(greatest(value, 1e-5))', 'compressed')}, round(greatest(value, 1e-5), 6) AS expanded FROM events",
)
def log_compression(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("event_id", s.log_compress(F.col("value")).alias("compressed"))
    both = events.withColumn("expanded", s.log_expand(F.col("compressed")))
    return both.select("event_id", r("compressed"), F.round("expanded", 6).alias("expanded"))


@query(
    "volume_w9",
    f"""WITH {SIGNAL_SQL}, sized AS (SELECT *, count(*) OVER (PARTITION BY utt, ch) AS n, max(abs(value)) OVER (PARTITION BY utt, ch) AS peak FROM signal),
    grid AS (SELECT DISTINCT utt, ch, n, peak, unnest(range(0, n // 4 + 1)) AS frame FROM sized),
    power AS (SELECT g.utt, g.ch, g.peak, g.frame, sum(x.value * x.value) / 16 AS power FROM grid g JOIN signal x
      ON x.utt = g.utt AND x.ch = g.ch AND x.t + 8 >= g.frame * 4 AND x.t + 8 < g.frame * 4 + 16 GROUP BY 1, 2, 3, 4),
    loud AS (SELECT utt, ch, max(peak) AS peak, 0.2 / (sqrt(max(power)) + 0.01) AS gain FROM power GROUP BY 1, 2)
    SELECT utt, ch, t, {rsql('value * CASE WHEN peak * gain > 1 THEN 1 / peak ELSE gain END', 'value')}
    FROM signal JOIN loud USING (utt, ch)""",
)
def volume(spark, sf_dir):
    return s.normalize_volume(signal(spark, sf_dir), KEYS, 16, 4).select(*KEYS, "t", r("value"))


@query(
    "peak_pcm_w10",
    f"""WITH {SIGNAL_SQL}, scaled AS (SELECT utt, ch, t, coalesce(value / nullif(max(abs(value)) OVER (PARTITION BY utt, ch), 0), 0) * 0.95::DOUBLE AS value FROM signal)
    SELECT utt, ch, t, {rsql('value', 'value', 9)}, CAST(trunc(value * 32768) AS SMALLINT) AS pcm,
      round(trunc(value * 32768) / 32768.0::DOUBLE, 9) AS back FROM scaled""",
)
def peak_pcm(spark, sf_dir):
    scaled = s.normalize_peak(signal(spark, sf_dir), KEYS).withColumn("pcm", s.to_pcm(F.col("value")))
    return scaled.select(*KEYS, "t", r("value", 9), "pcm", F.round(s.from_pcm(F.col("pcm")), 9).alias("back"))


def _causal_sql(x: str, b, a) -> tuple[str, str]:
    """Difference equation over list ``x``, at rest at its first value before it:
    the held list ``h`` that it reads, and the filtered list."""
    order = len(a) - 1
    gain = float(sum(b) / sum(a)) if abs(sum(b)) > 1e-12 else 0.0
    held = f"list_concat(list_transform(range({order}), lambda z: {x}[1]), {x})"
    taps = " + ".join(f"({float(w)!r}::DOUBLE) * h[i + {order - k}]" for k, w in enumerate(b))
    past = "".join(f" - ({float(w)!r}::DOUBLE) * y[-{k}]" for k, w in enumerate(a) if k)
    start = f"list_transform(range({order}), lambda z: {gain!r}::DOUBLE * {x}[1])"
    run = f"list_reduce(range(1, len({x}) + 1), lambda y, i: list_append(y, {taps}{past}), {start})"
    return held, f"({run})[{order + 1}:]"


def _zero_phase_sql(source: str, name: str, b, a, pad: int) -> str:
    """CTEs that filter the lists of ``source`` (utt, ch, x) forward and backward."""
    held, run = _causal_sql("x", b, a)
    return f"""{name}_e AS (SELECT utt, ch, list_concat(list_transform(range({pad}, 0, -1), lambda i: 2 * x[1] - x[i + 1]), x,
      list_transform(range(1, {pad + 1}), lambda i: 2 * x[-1] - x[-1 - i])) AS x FROM {source}),
    {name}_f AS (SELECT utt, ch, list_reverse({run}) AS x FROM (SELECT utt, ch, x, {held} AS h FROM {name}_e)),
    {name} AS (SELECT utt, ch, (list_reverse({run}))[{pad + 1}:-{pad + 1}] AS x FROM (SELECT utt, ch, x, {held} AS h FROM {name}_f))"""


def _condition_sql(notches: bool, drift: bool) -> str:
    """CTEs of the conditioning chain; the last is ``clean``."""
    designs = [dsp.notch(60.0 * k, 30.0, 250.0) for k in (1, 2)] if notches else []
    designs += [dsp.high_pass3(2.0, 250.0)] if drift else []
    parts, source = [f"{SIGNAL_SQL}, raw AS (SELECT utt, ch, list(value ORDER BY t) AS x FROM signal GROUP BY 1, 2)"], "raw"
    for k, (b, a) in enumerate(designs):
        parts.append(_zero_phase_sql(source, f"z{k}", b, a, 3 * len(a)))
        source = f"z{k}"
    parts.append(f"clean AS (SELECT utt, ch, unnest(range(len(x)))::INT AS t, unnest(x) AS value FROM {source})")
    return ", ".join(parts)


@query("notch_w11", f"WITH {_condition_sql(True, False)} SELECT utt, ch, t, {rsql('value', 'value', 4)} FROM clean")
def notch(spark, sf_dir):
    """Mains notches only."""
    return s.condition(signal(spark, sf_dir), KEYS, cut=0.0).select(*KEYS, "t", r("value", 4))


@query("drift_removal_w12", f"WITH {_condition_sql(False, True)} SELECT utt, ch, t, {rsql('value', 'value', 4)} FROM clean")
def drift_removal(spark, sf_dir):
    return s.condition(signal(spark, sf_dir), KEYS, mains=0.0).select(*KEYS, "t", r("value", 4))


_UP, _DOWN = dsp.rational_ratio(NEW_RATE, OLD_RATE)
_TAPS = dsp.polyphase_taps(_UP, _DOWN)
_LOAD_UP, _LOAD_DOWN = dsp.rational_ratio(400.0, 250.0)
_LOAD_TAPS = dsp.polyphase_taps(_LOAD_UP, _LOAD_DOWN)


@query(
    "resample_w13",
    f"""WITH {SIGNAL_SQL}, out AS (SELECT utt, ch, unnest(range(0, round_even(n * 1.6::DOUBLE, 0)::BIGINT))::INT AS q
      FROM (SELECT utt, ch, count(*) AS n FROM signal GROUP BY 1, 2))
    SELECT o.utt, o.ch, o.q AS t, {rsql(f'sum(x.value * ({_list(_TAPS)})[o.q * {_DOWN} - x.t * {_UP} + {len(_TAPS) // 2} + 1])', 'value', 4)}
    FROM out o JOIN signal x ON x.utt = o.utt AND x.ch = o.ch
      AND o.q * {_DOWN} - x.t * {_UP} BETWEEN -{len(_TAPS) // 2} AND {len(_TAPS) // 2} GROUP BY 1, 2, 3""",
)
def resample(spark, sf_dir):
    return s.resample(signal(spark, sf_dir), KEYS, NEW_RATE, OLD_RATE).select(*KEYS, "t", r("value", 4))


@query(
    "soft_clip_w14",
    "SELECT event_id, round(50 * tanh(value / 20 / 50), 6) AS value FROM events",
)
def soft_clip(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    return events.select("event_id", F.round(s.soft_clip(F.col("value")), 6).alias("value"))


@query(
    "load_signal_w14",
    f"""WITH {_condition_sql(True, True)}, out AS (SELECT utt, ch, unnest(range(0, round_even(n * 1.6::DOUBLE, 0)::BIGINT))::INT AS q
      FROM (SELECT utt, ch, count(*) AS n FROM clean GROUP BY 1, 2)),
    up AS (SELECT o.utt, o.ch, o.q AS t, sum(x.value * ({_list(_LOAD_TAPS)})[o.q * {_LOAD_DOWN} - x.t * {_LOAD_UP} + {len(_LOAD_TAPS) // 2} + 1]) AS value
      FROM out o JOIN clean x ON x.utt = o.utt AND x.ch = o.ch
        AND o.q * {_LOAD_DOWN} - x.t * {_LOAD_UP} BETWEEN -{len(_LOAD_TAPS) // 2} AND {len(_LOAD_TAPS) // 2} GROUP BY 1, 2, 3)
    SELECT utt, ch, t, {rsql('50 * tanh(value / 20 / 50)', 'value', 4)} FROM up""",
)
def load_signal(spark, sf_dir):
    """The whole conditioning path from raw samples to model input."""
    made = s.load_signal(signal(spark, sf_dir), KEYS, frame_rate=100.0)
    return made.select(*KEYS, "t", r("value", 4))


@query(
    "channel_projection_p6",
    f"WITH {SIGNAL_SQL} SELECT utt, CAST(1 - ch AS INT) AS ch, t, value FROM signal",
)
def channel_projection(spark, sf_dir):
    return s.pick_channels(signal(spark, sf_dir), [1, 0])
