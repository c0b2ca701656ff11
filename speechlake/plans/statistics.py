"""Statistics, normaliser and score queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions import arrays
from speechlake.operators import evaluation, stats
from speechlake.plans.corpus import SIGNAL_SQL, signal, table
from speechlake.plans.registry import query

CLASSES = 10
NOISE_CLASS = 9


def r6(column: str, name: str | None = None):
    return (F.round(column, 6) + F.lit(0.0)).alias(name or column)


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings")


VALUES_SQL = """vals AS (SELECT vec_id, label, d AS dim, embedding[d + 1]::DOUBLE AS x
  FROM embeddings, (SELECT unnest(range(64))::INT AS d))"""
STATS_SQL = f"""{VALUES_SQL}, st AS (SELECT dim, count(*) AS n, avg(x) AS mean, var_pop(x) * count(*) AS m2,
  greatest(stddev_pop(x), 1e-8) AS std FROM vals GROUP BY dim)"""


@query(
    "dim_moments_a2",
    f"WITH {STATS_SQL} SELECT dim, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(m2, 6) AS m2, round(std, 6) AS std FROM st",
)
def dim_moments(spark, sf_dir):
    made = stats.require_rows(stats.dim_moments(vectors(spark, sf_dir), "embedding"))
    return made.select("dim", "n", r6("mean"), F.round("m2", 6).alias("m2"), F.round("std", 6).alias("std"))


@query(
    "paired_moments_a2",
    f"""WITH {VALUES_SQL}, b AS (SELECT dim, x FROM vals UNION ALL SELECT v.dim, v.x FROM vals v
      JOIN embeddings s ON v.vec_id = s.vec_id + 1 WHERE s.label < 5)
    SELECT dim, count(*) AS n, round(avg(x), 6) + 0.0::DOUBLE AS mean, round(greatest(stddev_pop(x), 1e-8), 6) AS std FROM b GROUP BY dim""",
)
def paired_moments(spark, sf_dir):
    """Labels below 5 are silent rows; the following vector is their voiced partner."""
    vec = vectors(spark, sf_dir)
    silent = vec.where("label < 5").select((F.col("vec_id") + 1).alias("vec_id"))
    partner = vec.join(silent, "vec_id")
    made = stats.paired_moments(vec, "embedding", partner, "embedding")
    return made.select("dim", "n", r6("mean"), F.round("std", 6).alias("std"))


@query(
    "global_moments_a3",
    f"""WITH {VALUES_SQL}, g AS (SELECT count(*) AS n, avg(x) AS mean, stddev_pop(x) AS std FROM vals)
    SELECT d AS dim, n, round(mean, 6) + 0.0::DOUBLE AS mean, round(std, 6) AS std FROM g, (SELECT unnest(range(64))::INT AS d)""",
)
def global_moments(spark, sf_dir):
    made = stats.global_moments(vectors(spark, sf_dir), "embedding", 64)
    return made.select("dim", "n", r6("mean"), F.round("std", 6).alias("std"))


@query(
    "descriptive_stats_a4",
    """SELECT count(value) AS n, min(value) AS min, max(value) AS max, round(avg(value), 6) AS mean,
      round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std FROM events""",
)
def descriptive_stats(spark, sf_dir):
    made = stats.describe(table(spark, sf_dir, "events"), "value")
    return made.select("n", "min", "max", *[F.round(c, 6).alias(c) for c in ("mean", "median", "std")])


@query(
    "histogram_a5",
    """WITH s AS (SELECT min(value) AS lo, max(value) AS hi FROM events),
    c AS (SELECT CAST(least(50, floor(50.0::DOUBLE * (value - lo) / (hi - lo)) + 1) AS INT) AS bin, count(*) AS n
      FROM events, s GROUP BY 1)
    SELECT b AS bin, round(lo + (hi - lo) / 50 * (b - 1), 6) AS edge, coalesce(n, 0) AS n
    FROM (SELECT unnest(range(1, 51))::INT AS b) g LEFT JOIN c ON c.bin = g.b, s""",
)
def histogram(spark, sf_dir):
    made = stats.histogram(table(spark, sf_dir, "events"), "value", 50)
    return made.select("bin", F.round("edge", 6).alias("edge"), "n")


@query(
    "loudest_channel_a16",
    f"""WITH {SIGNAL_SQL}, e AS (SELECT utt, ch, sum(value * value) AS energy FROM signal GROUP BY 1, 2)
    SELECT utt, CAST(ch AS INT) AS ch, round(energy, 4) AS energy FROM e
    QUALIFY row_number() OVER (PARTITION BY utt ORDER BY energy DESC, ch) = 1""",
)
def loudest_channel(spark, sf_dir):
    loud = stats.loudest_channel(signal(spark, sf_dir), ["utt"])
    return loud.select("utt", "ch", F.round("energy", 4).alias("energy"))


@query(
    "loudest_samples_a16",
    f"""WITH {SIGNAL_SQL}, e AS (SELECT utt, ch, sum(value * value) AS energy FROM signal GROUP BY 1, 2),
    best AS (SELECT utt, ch FROM e QUALIFY row_number() OVER (PARTITION BY utt ORDER BY energy DESC, ch) = 1)
    SELECT utt, t, value FROM signal JOIN best USING (utt, ch)""",
)
def loudest_samples(spark, sf_dir):
    return stats.loudest_samples(signal(spark, sf_dir), ["utt"])


@query(
    "mean_abs_error_a18",
    f"""WITH {VALUES_SQL}, p AS (SELECT a.label, a.vec_id, avg(abs(a.x - b.x)) AS err FROM vals a
      JOIN vals b ON b.vec_id = a.vec_id + 1 AND b.dim = a.dim GROUP BY 1, 2)
    SELECT label, round(avg(err), 6) AS err FROM p GROUP BY label""",
)
def mean_abs_error(spark, sf_dir):
    vec = vectors(spark, sf_dir)
    double = F.col("embedding").cast("array<double>")
    left = vec.select("vec_id", "label", double.alias("a"))
    right = vec.select((F.col("vec_id") - 1).alias("vec_id"), double.alias("b"))
    items = left.join(right, "vec_id").withColumn("err", arrays.mean_abs_difference(F.col("a"), F.col("b")))
    return items.groupBy("label").agg(F.round(F.avg("err"), 6).alias("err"))


@query(
    "best_of_branches_a20",
    """SELECT doc_id, greatest(n_chars % 100, quality * 50) AS best FROM documents LEFT JOIN labels USING (doc_id)""",
)
def best_of_branches(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", (F.col("n_chars") % 100).alias("first"))
    second = table(spark, sf_dir, "labels").select("doc_id", (F.col("quality") * 50).cast("long").alias("second"))
    return docs.join(second, "doc_id", "left").select("doc_id", F.greatest("first", "second").alias("best"))


@query(
    "z_score_w26",
    f"""WITH {STATS_SQL} SELECT vec_id, dim, round((x - mean) / std, 6) + 0.0::DOUBLE AS z, round(x, 6) + 0.0::DOUBLE AS back
    FROM vals JOIN st USING (dim)""",
)
def z_score(spark, sf_dir):
    vec = vectors(spark, sf_dir).select("vec_id", F.col("embedding").cast("array<double>").alias("z"))
    moments = stats.dim_moments(vec, "z")
    scaled = stats.normalize(vec, "z", moments).withColumn("back", F.col("z"))
    back = stats.denormalize(scaled, "back", moments)
    rows = back.select("vec_id", F.posexplode(F.arrays_zip("z", "back")).alias("dim", "v"))
    return rows.select("vec_id", "dim", r6("v.z", "z"), r6("v.back", "back"))


@query(
    "top_k_mask_w30",
    f"""WITH {VALUES_SQL} SELECT vec_id, dim, CASE WHEN row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, dim) <= 8
      THEN round(x, 6) ELSE 0 END + 0.0::DOUBLE AS x FROM vals""",
)
def top_k_mask(spark, sf_dir):
    masked = vectors(spark, sf_dir).select(
        "vec_id", F.posexplode(arrays.top_k(F.col("embedding").cast("array<double>"), 8)).alias("dim", "x")
    )
    return masked.select("vec_id", "dim", r6("x"))


def frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class scores of a frame and its target class: class c gets the sum of
    every CLASSES-th entry of the vector from c on."""
    values = F.col("embedding").cast("array<double>")
    total = lambda c: F.aggregate(F.filter(values, lambda _, i: i % CLASSES == c), F.lit(0.0), lambda s, x: s + x)
    return vectors(spark, sf_dir).select("vec_id", "label", F.array(*map(total, range(CLASSES))).alias("scores"))


FRAMES_SQL = f"""{VALUES_SQL}, sc AS (SELECT vec_id, label, dim % {CLASSES} AS c, sum(x ORDER BY dim) AS x FROM vals GROUP BY 1, 2, 3),
  lse AS (SELECT vec_id, label, ln(sum(exp(x))) AS l FROM sc GROUP BY 1, 2),
  best AS (SELECT vec_id, label AS target, c AS pred FROM sc
    QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) = 1)"""


@query(
    "log_softmax_t18",
    f"WITH {FRAMES_SQL} SELECT vec_id, c, round(x - l, 6) AS lp FROM sc JOIN lse USING (vec_id)",
)
def log_softmax(spark, sf_dir):
    rows = frames(spark, sf_dir).select("vec_id", F.posexplode(arrays.log_softmax(F.col("scores"))).alias("c", "lp"))
    return rows.select("vec_id", "c", F.round("lp", 6).alias("lp"))


@query(
    "cross_entropy_t18",
    f"""WITH {FRAMES_SQL}, m AS (SELECT vec_id, c - 4 AS kept FROM sc WHERE c > 3
      QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY x DESC, c) = 1)
    SELECT sc.vec_id, CASE WHEN c = {NOISE_CLASS} THEN 0 ELSE round(l - x, 6) END AS nll, pred, kept
    FROM sc JOIN lse USING (vec_id) JOIN best USING (vec_id) JOIN m USING (vec_id) WHERE sc.label = c""",
)
def cross_entropy(spark, sf_dir):
    return frames(spark, sf_dir).select(
        "vec_id",
        F.round(arrays.cross_entropy(F.col("scores"), F.col("label"), NOISE_CLASS), 6).alias("nll"),
        arrays.argmax(F.col("scores")).alias("pred"),
        arrays.argmax_without(F.col("scores"), [0, 1, 2, 3], 4).alias("kept"),
    )


def judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames(spark, sf_dir).select(
        "vec_id", arrays.argmax(F.col("scores")).alias("pred"), F.col("label").alias("target")
    )


@query(
    "confusion_counts_a8",
    f"WITH {FRAMES_SQL} SELECT pred, target, count(*) AS n FROM best WHERE target <> {NOISE_CLASS} GROUP BY 1, 2",
)
def confusion_counts(spark, sf_dir):
    return evaluation.confusion_counts(judged(spark, sf_dir), noise=NOISE_CLASS)


_CONFUSION_SQL = f"""{FRAMES_SQL}, cells AS (SELECT pred, target, count(*) AS n FROM best GROUP BY 1, 2),
  tot AS (SELECT target AS c, sum(n) + 1e-4::DOUBLE AS t FROM cells GROUP BY 1),
  pairs AS (SELECT p.c AS p, q.c AS q, p.t + q.t AS t,
      coalesce((SELECT sum(n) FROM cells WHERE (pred = p.c AND target = q.c) OR (pred = q.c AND target = p.c)), 0)::DOUBLE AS swapped,
      coalesce((SELECT sum(n) FROM cells WHERE pred = target AND pred IN (p.c, q.c)), 0)::DOUBLE AS hits
    FROM tot p JOIN tot q ON q.c < p.c)"""


@query(
    "top_confusions_a9",
    f"""WITH {_CONFUSION_SQL} SELECT p, q, round(swapped / t, 6) AS confusion, round(hits / t, 6) AS accuracy
    FROM pairs ORDER BY swapped / t DESC, p DESC, q DESC LIMIT 10""",
)
def top_confusions(spark, sf_dir):
    counts = evaluation.confusion_counts(judged(spark, sf_dir))
    top = evaluation.confused_pairs(counts, 10)
    return top.select("p", "q", F.round("confusion", 6).alias("confusion"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "label_pairs_j9",
    f"""WITH {_CONFUSION_SQL} SELECT p, q, round(swapped / t, 6) AS confusion, round(hits / t, 6) AS accuracy
    FROM pairs WHERE swapped > 0""",
)
def label_pairs(spark, sf_dir):
    """All unordered label pairs that were ever confused."""
    counts = evaluation.confusion_counts(judged(spark, sf_dir))
    return evaluation.pair_confusions(counts).select("p", "q", F.round("confusion", 6).alias("confusion"), F.round("accuracy", 6).alias("accuracy"))


@query(
    "masked_accuracy_a10",
    f"""WITH {FRAMES_SQL} SELECT CAST(vec_id % 7 AS INT) AS session,
      round(coalesce(count(*) FILTER (pred = target AND target <> {NOISE_CLASS}) / nullif(count(*) FILTER (target <> {NOISE_CLASS}), 0), 0), 6) AS accuracy,
      count(*) FILTER (target <> {NOISE_CLASS}) AS frames FROM best GROUP BY 1""",
)
def masked_accuracy(spark, sf_dir):
    rows = judged(spark, sf_dir).withColumn("session", (F.col("vec_id") % 7).cast("int"))
    made = evaluation.masked_accuracy(rows, "pred", "target", NOISE_CLASS, "session")
    return made.withColumn("accuracy", F.round("accuracy", 6))
