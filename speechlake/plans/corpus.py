"""The corpus view of the given tables, in Spark and in SQL.

The tables are not recordings, so each concept is a projection of one of them:
a user of ``events`` is an utterance whose samples are ordered by time, the
documents are recordings of a session (their source), and neighbouring turns of
a conversation are a target and a prediction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.operators.chunks import spread
from speechlake.operators.ordering import dense_index

# The event kinds in id order, playing the phoneme inventory.
PHONES = ["click", "purchase", "signup", "error", "view"]
NOISE = "error"
SILENCE = "view"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents for work that is costly per text, dealt out evenly."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Samples of every utterance: utt, t, value, k, event_type."""
    events = table(spark, sf_dir, "events").select(
        F.col("user_id").alias("utt"),
        "ts",
        "event_id",
        "value",
        F.get_json_object("props", "$.k").cast("int").alias("k"),
        "event_type",
    )
    micros = F.unix_micros(F.col("ts").cast("timestamp"))
    indexed = dense_index(events, ["utt"], [F.col("ts"), F.col("event_id")], micros)
    return indexed.select("utt", F.col("t").cast("int").alias("t"), "value", "k", "event_type")


SAMPLES_SQL = r"""samples AS (
  SELECT user_id AS utt,
         CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS INT) AS t,
         value, CAST(regexp_extract(props, '([0-9]+)', 1) AS INT) AS k, event_type
  FROM events)"""


def signal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-channel signal in long view: utt, ch, t, value."""
    return signal_of(samples(spark, sf_dir))


def signal_of(rows: DataFrame) -> DataFrame:
    channels = F.array(
        F.struct(F.lit(0).alias("ch"), F.col("value").alias("value")),
        F.struct(F.lit(1).alias("ch"), F.col("k").cast("double").alias("value")),
    )
    return rows.select("utt", "t", F.inline(channels)).select("utt", "ch", "t", "value")


SIGNAL_SQL = (
    SAMPLES_SQL
    + """, signal AS (
  SELECT utt, 0 AS ch, t, value FROM samples
  UNION ALL SELECT utt, 1 AS ch, t, CAST(k AS DOUBLE) AS value FROM samples)"""
)


def intervals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotation tier: interval i of an utterance spans samples t and t + 1 + (k % 3).

    Lengths of 0.1 to 0.3 s make neighbours overlap or leave gaps.
    """
    return intervals_of(samples(spark, sf_dir))


def intervals_of(rows: DataFrame) -> DataFrame:
    start = F.col("t") * 0.2
    return rows.select(
        "utt",
        F.lit("phones").alias("tier"),
        F.col("t").alias("idx"),
        start.alias("xmin"),
        (start + (F.col("k") % 3 + 1) * 0.1).alias("xmax"),
        F.col("event_type").alias("label"),
    )


INTERVALS_SQL = (
    SAMPLES_SQL
    + """, intervals AS (
  SELECT utt, 'phones' AS tier, t AS idx, t * 0.2::DOUBLE AS xmin,
         t * 0.2::DOUBLE + (k % 3 + 1) * 0.1::DOUBLE AS xmax, event_type AS label
  FROM samples)"""
)


def turn_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every user turn (target) with the assistant turn right after it (prediction)."""
    turns = table(spark, sf_dir, "conversations")
    target = spread(
        turns.where("role = 'user'").select("conv_id", "turn", F.col("text").alias("target")), "conv_id", "turn"
    )
    answer = turns.where("role = 'assistant'").select(
        "conv_id", (F.col("turn") - 1).alias("turn"), F.col("text").alias("prediction")
    )
    return target.join(answer, ["conv_id", "turn"])


PAIRS_SQL = """pairs AS (
  SELECT u.conv_id, u.turn, u.text AS target, a.text AS prediction
  FROM conversations u JOIN conversations a
    ON a.conv_id = u.conv_id AND a.turn = u.turn + 1
  WHERE u.role = 'user' AND a.role = 'assistant')"""


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Manifest rows: labelled documents are silent recordings, all are voiced ones.

    Columns session, data_type, data_num, path. Numbers ending in 7 have two voiced files.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    labels = table(spark, sf_dir, "labels").select("doc_id")
    path = lambda kind, copy: F.format_string(
        "corpus/%s/%s/data/emg/emg%s_%04d.npz", F.lit(kind), F.col("source"), F.lit(copy), F.col("doc_id")
    )
    silent = docs.join(labels, "doc_id", "left_semi").select(
        F.col("source").alias("session"),
        F.lit("silent").alias("data_type"),
        F.col("doc_id").cast("int").alias("data_num"),
        path("silent", "").alias("path"),
    )
    copies = F.when(F.col("doc_id") % 10 == 7, F.array(path("voiced", ""), path("voiced", "b"))).otherwise(
        F.array(path("voiced", ""))
    )
    voiced = docs.where("doc_id % 11 <> 3").select(
        F.col("source").alias("session"),
        F.lit("voiced").alias("data_type"),
        F.col("doc_id").cast("int").alias("data_num"),
        F.explode(copies).alias("path"),
    )
    return silent.unionByName(voiced)


RECORDINGS_SQL = """recordings AS (
  SELECT source AS session, 'silent' AS data_type, CAST(doc_id AS INT) AS data_num,
         'corpus/silent/' || source || '/data/emg/emg_' || printf('%04d', doc_id) || '.npz' AS path
  FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)
  UNION ALL
  SELECT source, 'voiced', CAST(doc_id AS INT),
         'corpus/voiced/' || source || '/data/emg/emg' || c.copy || '_' || printf('%04d', doc_id) || '.npz'
  FROM documents, (VALUES (''), ('b')) AS c(copy)
  WHERE doc_id % 11 <> 3 AND (c.copy = '' OR doc_id % 10 = 7))"""
