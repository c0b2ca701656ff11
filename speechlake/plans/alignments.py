"""Sequence alignment queries.

A pair is an utterance (prediction) and the next one (target), both whole; even
utterances are silent, hence warped. Voiced pairs are cut to their common length
around the centre first, as recordings of one text are. Utterances end after
``MAX_FRAMES`` frames, as in the batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import arrays, warp
from speechlake.operators import alignment as al
from speechlake.operators import evaluation
from speechlake.operators.chunks import chunk_of, spread
from speechlake.plans.corpus import PHONES, SAMPLES_SQL, samples, signal
from speechlake.plans.registry import query
from speechlake.sources.scratch import stored

# Eight seconds at 100 frames a second, the longest utterance of a batch.
MAX_FRAMES = 800
WEIGHT = 0.5
NOISE_ID = PHONES.index("error")
KEYS = ["utt"]


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Features, phone and class scores of every sample."""
    value, k = F.col("value"), F.col("k")
    return samples(spark, sf_dir).select(
        "utt", "t",
        F.array(value / 100, k / 100).alias("feat"),
        (F.array_position(F.lit(PHONES), F.col("event_type")) - 1).cast("int").alias("phone"),
        F.array(*[-F.abs(value - 20 * c) / 10 for c in range(len(PHONES))]).alias("scores"),
    )


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Stored once: an utterance is read as prediction and as target."""
    kept = frames(spark, sf_dir).where(F.col("t") < MAX_FRAMES)
    return stored(al.sequence_arrays(kept, "utt", ["feat", "phone", "scores"]), "sequences")


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Silent pairs as they are, voiced ones at the common length."""
    seqs = sequences(spark, sf_dir)
    pred = spread(seqs.select("utt", "feat", "scores"), *KEYS)
    target = seqs.select((F.col("utt") - 1).alias("utt"), F.col("feat").alias("y"), F.col("phone").alias("phones"))
    both = pred.join(target, KEYS).withColumn("silent", F.col("utt") % 2 == 0)
    n = F.least(F.size("feat"), F.size("y"))
    cut = lambda c: F.when(F.col("silent"), F.col(c)).otherwise(arrays.center_trim(F.col(c), n))
    return both.select(*KEYS, "silent", *[cut(c).alias(c) for c in ("feat", "scores", "y", "phones")])


# A voiced side of n samples loses (n - common) // 2 of them at the start.
PAIRS_SQL = f"""{SAMPLES_SQL}, fr AS (
  SELECT utt, t::INT AS i, value, value / 100 AS f0, k / 100 AS f1, list_position({PHONES!r}, event_type) - 1 AS phone FROM samples WHERE t < {MAX_FRAMES}),
sz AS (SELECT utt, count(*) AS n FROM fr GROUP BY 1),
pr AS (SELECT p.utt, p.utt % 2 = 0 AS silent, CASE WHEN p.utt % 2 = 0 THEN p.n ELSE least(p.n, y.n) END AS n,
    CASE WHEN p.utt % 2 = 0 THEN y.n ELSE least(p.n, y.n) END AS m,
    CASE WHEN p.utt % 2 = 0 THEN 0 ELSE (p.n - least(p.n, y.n)) // 2 END AS p0,
    CASE WHEN p.utt % 2 = 0 THEN 0 ELSE (y.n - least(p.n, y.n)) // 2 END AS y0 FROM sz p JOIN sz y ON y.utt = p.utt + 1),
pf AS (SELECT pr.utt, f.i - p0 AS i, f.i AS at, value, f0, f1 FROM pr JOIN fr f ON f.utt = pr.utt AND f.i >= p0 AND f.i < p0 + pr.n),
yf AS (SELECT pr.utt, f.i - y0 AS i, f0, f1, phone FROM pr JOIN fr f ON f.utt = pr.utt + 1 AND f.i >= y0 AND f.i < y0 + pr.m),
sc AS (SELECT utt, i, c, -abs(value - 20 * c) / 10 AS s FROM pf, (SELECT unnest(range({len(PHONES)})) AS c)),
lse AS (SELECT utt, i, ln(sum(exp(s))) AS l, (list(c ORDER BY s DESC, c))[1] AS best FROM sc GROUP BY 1, 2),
cells AS (
  SELECT pr.utt, pr.silent, pr.n, pr.m, y.i AS t, p.i AS j, y.phone,
    sqrt((y.f0 - p.f0) * (y.f0 - p.f0) + (y.f1 - p.f1) * (y.f1 - p.f1)) AS dist, lse.l - sc.s AS nll, lse.best
  FROM pr JOIN pf p ON p.utt = pr.utt JOIN yf y ON y.utt = pr.utt
  JOIN lse ON lse.utt = p.utt AND lse.i = p.i
  JOIN sc ON sc.utt = p.utt AND sc.i = p.i AND sc.c = y.phone),
costed AS (SELECT *, dist * 0.5 + CASE WHEN phone = {NOISE_ID} THEN 0 ELSE {WEIGHT} * nll END AS cost FROM cells)"""

# Accumulated cost as a list of rows, then the way back one step at a time.
WARP_SQL = f"""{PAIRS_SQL}, rows AS (SELECT utt, n, m, t, list(cost ORDER BY j) AS r FROM costed WHERE silent GROUP BY ALL),
mats AS (SELECT utt, n, m, list(r ORDER BY t) AS c FROM rows GROUP BY ALL),
acc AS (SELECT utt, n, m, list_reduce(list_transform(c[2:], lambda r: [r]), lambda a, r:
    list_append(a, list_reduce(range(2, n + 1), lambda row, j:
      list_append(row, r[1][j] + least(a[-1][j], row[j - 1], a[-1][j - 1])), ['inf'::DOUBLE])),
    [list_concat([0::DOUBLE], list_transform(range(1, n), lambda x: 'inf'::DOUBLE))]) AS d FROM mats),
back AS (
  SELECT utt, m - 1 AS i, n - 1 AS j FROM acc
  UNION ALL
  SELECT b.utt, CASE WHEN up <= least(side, diag) OR diag < side THEN b.i - 1 ELSE b.i END,
    CASE WHEN up <= least(side, diag) THEN b.j ELSE b.j - 1 END
  FROM (SELECT b.*, d[b.i][b.j + 1] AS up, d[b.i + 1][b.j] AS side, d[b.i][b.j] AS diag
    FROM back b JOIN acc USING (utt) WHERE b.i > 0 AND b.j > 0) b),
hits AS (SELECT utt, i AS t, min(j) AS j FROM back WHERE i > 0 AND j > 0 GROUP BY 1, 2),
matches AS (
  SELECT g.utt, g.t, coalesce(h.j, 0) AS j FROM (SELECT utt, unnest(range(m)) AS t FROM acc) g LEFT JOIN hits h USING (utt, t)
  UNION ALL SELECT utt, t, t FROM (SELECT utt, unnest(range(m)) AS t FROM pr WHERE NOT silent)),
voiced AS (SELECT p.utt, p.i AS t, sqrt(power(y.f0 - p.f0 + 1e-6, 2) + power(y.f1 - p.f1 + 1e-6, 2)) AS vdist
  FROM pf p JOIN yf y ON y.utt = p.utt AND y.i = p.i),
frames AS (
  SELECT c.utt, c.silent, c.t, c.j, CASE WHEN c.silent THEN c.dist ELSE v.vdist END AS dist, c.nll, c.best AS pred,
    c.phone AS target, c.phone <> {NOISE_ID} AS valid
  FROM matches m JOIN costed c ON c.utt = m.utt AND c.t = m.t AND c.j = m.j
  LEFT JOIN voiced v ON v.utt = c.utt AND v.t = c.t)"""


@query(
    "distance_matrix_j10",
    f"""WITH {PAIRS_SQL} SELECT utt, j AS pred_t, round(min(dist), 6) AS nearest, round(sum(dist), 5) AS total
    FROM cells GROUP BY 1, 2""",
)
def distance_matrix(spark, sf_dir):
    """All distances inside a pair, reported per predicted frame."""
    profile = pairs(spark, sf_dir).select(*KEYS, warp.distance_profile("feat", "y").alias("d"))
    rows = profile.select(*KEYS, F.posexplode_outer(F.arrays_zip("d.nearest", "d.total")).alias("pred_t", "r"))
    return rows.select(*KEYS, "pred_t", F.round("r.nearest", 6).alias("nearest"), F.round("r.total", 5).alias("total"))


@query(
    "aligned_distance_j10",
    f"""WITH {SAMPLES_SQL} SELECT p.utt, p.t, round(sqrt(power(y.value / 100 - p.value / 100 + 1e-6, 2) + power(y.k / 100 - p.k / 100 + 1e-6, 2)), 6) AS dist
    FROM samples p JOIN samples y ON y.utt = p.utt + 1 AND y.t = p.t""",
)
def aligned_distance(spark, sf_dir):
    pred = frames(spark, sf_dir)
    target = pred.withColumn("utt", F.col("utt") - 1)
    return al.aligned_distance(pred, target, ["utt", "t"]).select("utt", "t", F.round("dist", 6).alias("dist"))


def silent_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pairs(spark, sf_dir).where("silent").select(*KEYS, "y", "feat")


_PLAIN_WARP_SQL = "WITH RECURSIVE " + WARP_SQL.replace("list(cost ORDER BY j)", "list(dist ORDER BY j)")


@query("warp_cost_d1", f"{_PLAIN_WARP_SQL} SELECT utt, round(CASE WHEN n = 1 AND m > 1 OR m = 1 AND n > 1 THEN 'inf'::DOUBLE ELSE d[-1][-1] END, 6) AS cost FROM acc")
def warp_cost(spark, sf_dir):
    return silent_pairs(spark, sf_dir).select(*KEYS, F.round(warp.warp_cost("y", "feat"), 6).alias("cost"))


@query(
    "align_rows_d2",
    f"{_PLAIN_WARP_SQL} SELECT m.utt, m.t::INT AS t, m.j::INT AS pred_t FROM matches m WHERE m.utt % 2 = 0",
)
def align_rows(spark, sf_dir):
    aligned = silent_pairs(spark, sf_dir).withColumn("a", warp.align_rows("y", "feat"))
    return aligned.select(*KEYS, F.posexplode_outer("a").alias("t", "pred_t"))


def frames_of(both: DataFrame) -> DataFrame:
    return al.aligned_frames(al.align_pairs(both, WEIGHT, NOISE_ID), KEYS, NOISE_ID)


def aligned_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames_of(pairs(spark, sf_dir))


@query(
    "pair_scores_d3",
    f"""WITH RECURSIVE {WARP_SQL} SELECT utt, round(sum(dist * 0.5 + CASE WHEN valid THEN {WEIGHT} * nll ELSE 0 END), 5) AS cost,
      round(sum(dist), 5) AS dist, round(sum(CASE WHEN valid THEN nll ELSE 0 END), 5) AS nll, count(*) AS frames FROM frames GROUP BY 1""",
)
def pair_scores(spark, sf_dir):
    scores = al.pair_scores(aligned_frames(spark, sf_dir), KEYS, WEIGHT)
    return scores.select(*KEYS, *[F.round(c, 5).alias(c) for c in ("cost", "dist", "nll")], "frames")


@query(
    "alignment_gather_j11",
    f"""WITH RECURSIVE {WARP_SQL} SELECT m.utt, m.t::INT AS t, m.j::INT AS pred_t, round(p.value, 6) AS value
    FROM matches m JOIN pf p ON p.utt = m.utt AND p.i = m.j""",
)
def alignment_gather(spark, sf_dir):
    """The predicted sample behind every target frame, by an equality join."""
    both = pairs(spark, sf_dir)
    matches = frames_of(both).select(*KEYS, "t", "pred_t")
    # The first feature is a hundredth of the value.
    pred = both.select(*KEYS, F.posexplode_outer("feat").alias("t", "f")).select(*KEYS, "t", (F.get("f", F.lit(0)) * 100).alias("value"))
    return al.gather(pred, matches, KEYS).withColumn("value", F.round("value", 6))


@query(
    "sequence_losses_a11",
    f"""WITH RECURSIVE {WARP_SQL}, s AS (SELECT sum(dist) AS d, sum(CASE WHEN valid THEN nll ELSE 0 END) AS p, count(*) AS n,
      count(*) FILTER (valid) AS m FROM frames)
    SELECT round(d / n * 0.5 + {WEIGHT} * p / m, 6) AS loss, round(d / n, 6) AS loss_dist, round(p / m, 6) AS loss_ph FROM s""",
)
def sequence_losses(spark, sf_dir):
    made = evaluation.sequence_losses(aligned_frames(spark, sf_dir), WEIGHT, 2, noise_known=True)
    return made.select(*[F.round(c, 6).alias(c) for c in ("loss", "loss_dist", "loss_ph")])


@query(
    "aligned_accuracy_a10",
    f"""WITH RECURSIVE {WARP_SQL} SELECT silent, round(count(*) FILTER (valid AND pred = target) / count(*) FILTER (valid), 6) AS accuracy,
      count(*) FILTER (valid) AS frames FROM frames GROUP BY 1""",
)
def aligned_accuracy(spark, sf_dir):
    made = evaluation.masked_accuracy(aligned_frames(spark, sf_dir), "pred", "target", NOISE_ID, "silent")
    return made.withColumn("accuracy", F.round("accuracy", 6))


@query(
    "channel_extension_u1",
    f"""WITH {SAMPLES_SQL}, s AS (SELECT utt, 0 AS ch, t, value FROM samples UNION ALL SELECT utt, 1, t, k FROM samples)
    SELECT utt, t // 65536 AS chunk, ch, round(max(value) - min(value), 6) AS spread FROM s GROUP BY 1, 2, 3""",
)
def channel_extension(spark, sf_dir):
    """A user function per channel and chunk."""

    def spread_of(pdf: pd.DataFrame) -> pd.DataFrame:
        made = round(float(np.ptp(pdf["value"].to_numpy())), 6)
        return pd.DataFrame({"utt": [pdf["utt"].iloc[0]], "chunk": [pdf["chunk"].iloc[0]], "ch": [pdf["ch"].iloc[0]], "spread": [made]})

    chunked = signal(spark, sf_dir).withColumn("chunk", chunk_of("t"))
    return al.apply_per_channel(chunked, spread_of, ["utt", "chunk"], "utt long, chunk long, ch int, spread double")


@query(
    "pair_extension_u2",
    f"""WITH {PAIRS_SQL} SELECT utt, m AS frames FROM pr""",
)
def pair_extension(spark, sf_dir):
    """A user scorer per pair."""

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"utt": pdf["utt"], "frames": pdf["y"].map(len)})

    return al.score_pairs(pairs(spark, sf_dir).select(*KEYS, "y"), count, KEYS, "utt long, frames long")
