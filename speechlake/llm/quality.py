"""Quality rules with host verdicts.

Every text is measured by itself. A document fails a rule by its own figures;
the failures are then counted per host (``source``), the host's failure rate is
shrunk towards the mean of all hosts with a beta prior fitted to their rates,
and hosts above ``host_limit`` are rejected with all their documents.

Defined results: a null text has no words and fails ``few_words``; a null
source is no host, so no verdict falls on it; repeated rows count as often as
they occur; an empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlake.llm.common import query, ship, table

NAMES = ("n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words")
MEASURES = T.StructType([T.StructField(n, T.LongType()) for n in NAMES])
SYMBOLS = b"#*$%&|<>"
BLANKS = b"\x20\x09\x0a\x0b\x0c\x0d"
# Copies of a host's verdict, so that the rows of a large host spread over tasks.
SALTS = 32


def repeated_words(words: list[bytes]) -> int:
    """Words inside 3-word windows that occur at least twice."""
    n = len(words)
    if n < 4:
        return 0
    seen: dict[bytes, int] = {}
    ids = np.fromiter((seen.setdefault(w, len(seen)) for w in words), np.int64, n)
    kinds = len(seen)
    pairs = ids[:-2] * kinds + ids[1:-1]
    if kinds**3 >= 2**63:  # number the pairs, so that the product below still fits
        pairs = np.unique(pairs, return_inverse=True)[1]
    _, place, count = np.unique(pairs * kinds + ids[2:], return_inverse=True, return_counts=True)
    twice = count[place] > 1
    inside = np.zeros(n, bool)
    for shift in range(3):
        inside[shift : n - 2 + shift] |= twice
    return int(inside.sum())


def measure(text: str | None) -> tuple[int, int, int, int, int, int]:
    if not text:
        return 0, 0, 0, 0, 0, 0
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.strip(BLANKS)]
    blanks = len(raw) - len(raw.translate(None, BLANKS))
    symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    return len(words), len(text) - blanks, symbols, len(lines), len(lines) - len(set(lines)), repeated_words(words)


@F.pandas_udf(MEASURES)
def _measures(texts: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([measure(t) for t in texts], columns=NAMES).astype("int64")


def rules(m: Column) -> dict[str, Column]:
    """Whether a document fails, by rule."""
    return {
        "few_words": m["n_words"] < 50,
        "repeats": 100 * m["n_repeat_words"] > 50 * m["n_words"],
        "symbols": 10 * m["n_symbols"] > m["n_words"],
        "dup_lines": 10 * m["n_dup_lines"] > 3 * m["n_lines"],
        "word_length": (m["word_chars"] < 3 * m["n_words"]) | (m["word_chars"] > 10 * m["n_words"]),
    }


def measured(docs: DataFrame, text: str = "text") -> DataFrame:
    """The documents with ``_m``: measures, failures and the base verdict."""
    found = docs.withColumn("_m", _measures(F.col(text)))
    failed = rules(F.col("_m"))
    return found.withColumn(
        "_m",
        F.struct(
            "_m.*",
            sum((f.cast("int") for f in failed.values()), F.lit(0)).cast("long").alias("n_failed"),
            (failed["few_words"] | failed["repeats"]).alias("base_failed"),
        ),
    )


def host_verdicts(measures: DataFrame, host: str = "source", host_limit: float = 0.5) -> DataFrame:
    """Per host: documents, failing documents and whether it is rejected.

    The prior is a beta distribution with the mean and variance of the hosts'
    rates (method of moments); with one host or equal rates it carries
    ``10**6`` documents' weight, so every host keeps the mean.
    """
    hosts = (
        measures.where(F.col(host).isNotNull())
        .groupBy(F.col(host).alias("host"))
        .agg(F.count(F.lit(1)).alias("n_docs"), F.sum((F.col("_m.n_failed") > 0).cast("long")).alias("n_bad"))
    )
    rate = F.col("n_bad") / F.col("n_docs")
    prior = hosts.agg(F.avg(rate).alias("mean"), F.var_pop(rate).alias("spread"))
    weight = F.when(F.col("spread") > 1e-12, F.col("mean") * (1 - F.col("mean")) / F.col("spread") - 1).otherwise(1e6)
    prior = prior.select("mean", F.least(F.greatest(weight, F.lit(1.0)), F.lit(1e6)).alias("weight"))
    shrunk = (F.col("n_bad") + F.col("mean") * F.col("weight")) / (F.col("n_docs") + F.col("weight"))
    # The prior is one row.
    return hosts.join(F.broadcast(prior)).select("host", "n_docs", "n_bad", (shrunk > host_limit).alias("host_failed"))


def judged(docs: DataFrame, verdicts: DataFrame, host: str = "source") -> DataFrame:
    """Measured documents with ``_v``: their host's verdict, null without one."""
    salted = verdicts.select(
        F.col("host").alias("_host"),
        F.struct("n_docs", "n_bad", "host_failed").alias("_v"),
        F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"),
    )
    spread = docs.withColumn("_salt_of", F.pmod(F.xxhash64(F.struct("_m.*")), F.lit(SALTS)).cast("int"))
    on = (F.col(host) == F.col("_host")) & (F.col("_salt_of") == F.col("_salt"))
    return spread.join(salted, on, "left").drop("_host", "_salt", "_salt_of")


def kept() -> Column:
    return ~F.col("_m.base_failed") & ~F.coalesce(F.col("_v.host_failed"), F.lit(False))


def keep_documents(docs: DataFrame, host: str = "source", text: str = "text") -> DataFrame:
    """The documents that pass, with their columns.

    The texts are measured twice, which costs less than moving them.
    """
    from speechlake.sources.scratch import stored

    narrow = docs.select(F.col(host).alias("source"), F.col(text).alias("text"))
    verdicts = stored(host_verdicts(measured(narrow)), "hosts")
    return judged(measured(docs, text), verdicts, host).where(kept()).select(*docs.columns)


OP3_SQL = r"""
WITH texts AS (
  SELECT row_number() OVER () AS r, doc_id, source, coalesce(text, '') AS t FROM documents
), words AS (
  SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM texts
), windows AS (
  SELECT r, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS i FROM words WHERE len(w) >= 3)
), twice AS (
  SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS c FROM windows) WHERE c > 1
), repeats AS (
  SELECT r, count(DISTINCT i + s) AS n FROM twice, (VALUES (0), (1), (2)) AS shifts(s) GROUP BY r
), m AS (
  SELECT t.doc_id, t.source, CAST(len(w.w) AS BIGINT) AS n_words,
         CAST(length(t.t) - length(regexp_replace(t.t, '[^\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
         CAST(length(regexp_replace(t.t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
         CAST(len(w.lines) AS BIGINT) AS n_lines,
         CAST(len(w.lines) - len(list_distinct(w.lines)) AS BIGINT) AS n_dup_lines,
         CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words
  FROM texts t JOIN words w USING (r) LEFT JOIN repeats p USING (r)
), judged AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CAST((n_words < 50) AS INT) + CAST((100 * n_repeat_words > 50 * n_words) AS INT)
         + CAST((10 * n_symbols > n_words) AS INT) + CAST((10 * n_dup_lines > 3 * n_lines) AS INT)
         + CAST((word_chars < 3 * n_words OR word_chars > 10 * n_words) AS INT) AS failures
  FROM m
), hosts AS (
  SELECT source, count(*) AS n_docs, count(*) FILTER (WHERE failures > 0) AS n_bad
  FROM judged WHERE source IS NOT NULL GROUP BY source
), prior AS (
  SELECT avg(n_bad / n_docs) AS mean, var_pop(n_bad / n_docs) AS spread FROM hosts
), weighted AS (
  SELECT mean, least(greatest(CASE WHEN spread > 1e-12 THEN mean * (1 - mean) / spread - 1 ELSE 1e6 END, 1.0), 1e6) AS weight
  FROM prior
), verdicts AS (
  SELECT source, n_docs, n_bad, (n_bad + mean * weight) / (n_docs + weight) > 0.5 AS host_failed FROM hosts, weighted
)
SELECT j.doc_id, j.n_words, j.word_chars, j.n_symbols, j.n_dup_lines, j.n_repeat_words, j.base_failed,
       CAST(j.failures AS BIGINT) AS n_failed, CAST(v.n_docs AS BIGINT) AS host_docs, CAST(v.n_bad AS BIGINT) AS host_bad,
       NOT j.base_failed AND NOT coalesce(v.host_failed, false) AS kept
FROM judged j LEFT JOIN verdicts v ON j.source = v.source
"""


@query("op3_quality_rules", OP3_SQL)
def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from speechlake.sources.scratch import stored

    ship(spark)
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    measures = stored(measured(docs).drop("text"), "measures")
    return judged(measures, host_verdicts(measures)).select(
        "doc_id",
        *(F.col(f"_m.{n}") for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "n_failed")),
        F.col("_v.n_docs").alias("host_docs"),
        F.col("_v.n_bad").alias("host_bad"),
        kept().alias("kept"),
    )
