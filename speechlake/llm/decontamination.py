"""Benchmark decontamination by winnowing.

A span of ``WINDOW`` words has ``WINDOW - GRAM + 1`` word k-grams; its
fingerprint is the smallest of their hashes. It depends on the span alone, so a
span that document and benchmark share has the same fingerprint on both sides.
Fingerprints of the documents meet those of the benchmark first, as distinct
values per document; in documents with a meeting, each such k-gram is extended
to the whole span, which must be equal (64-bit hash next to the 64-bit
fingerprint). Items with fewer words are one span of their own length, whose
fingerprint is the hash of all its words.

Defined results: null, empty and wordless texts have no words and no hits; a
wordless item is never hit; repeated rows get the same result each; items of
one id count once, those without an id as one item, which has no name in the
digest; empty tables give no rows or no hits; other columns are not
looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.let import let
from speechlake.llm.common import ascii_lower, query, table
from speechlake.sources.scratch import stored

WINDOW = 10
GRAM = 6
# Fixed value: what separates words, after A-Z have become a-z.
BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), BETWEEN), "")


def _starts(words: Column, size: int) -> Column:
    """1, 2, ... for every span of ``size`` words."""
    return F.when(F.size(words) >= size, F.sequence(F.lit(1), F.size(words) - size + 1)).otherwise(F.array().cast("array<int>"))


def _hashes(words: Column, size: int) -> Column:
    return F.transform(_starts(words, size), lambda i: F.xxhash64(F.slice(words, i, size)))


def _prints(words: Column, size: int) -> Column:
    """The fingerprint of every span of ``size`` words."""
    if size < WINDOW:
        return _hashes(words, size)
    width = WINDOW - GRAM + 1
    return let(_hashes(words, GRAM), lambda g: F.transform(_starts(g, width), lambda i: F.array_min(F.slice(g, i, width))))


def _spans(texts: DataFrame, size: int, *ids: str) -> DataFrame:
    """``ids, size, at, print, span`` of every span of ``size`` words of ``text``."""
    pair = lambda p, h: F.struct(p.alias("print"), h.alias("span"))
    spans = let(words_of(F.col("text")), lambda w: F.zip_with(_prints(w, size), _hashes(w, size), pair))
    return (
        texts.select(*ids, spans.alias("spans"))
        # The inner form would make the planner test the size below the joins, on a copy of the whole expression.
        .select(*ids, F.posexplode_outer("spans").alias("at", "s"))
        .select(*ids, F.lit(size).alias("size"), "at", "s.print", "s.span")
    )


def benchmark_spans(benchmark: DataFrame, item_id: str = "item_id", text: str = "text") -> DataFrame:
    """``size, print, span, item_id`` of all items, each once."""
    items = benchmark.select(F.col(item_id).alias("item_id"), F.col(text).alias("text"))
    full = _spans(items, WINDOW, "item_id")
    for size in range(1, WINDOW):
        full = full.union(_spans(items.where(F.size(words_of(F.col("text"))) == size), size, "item_id"))
    return full.where("print IS NOT NULL").select("size", "print", "span", "item_id").distinct()


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Equal rows have equal keys and equal results."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))


def find_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """Two tables: ``doc_id, text_key, n_words`` per distinct document, and
    ``doc_id, text_key, n_hit, items`` per document with a hit."""
    known = stored(benchmark_spans(benchmark), "benchmark-spans")
    # At most WINDOW rows: the span lengths that the items call for.
    sizes = sorted(r["size"] for r in known.select("size").distinct().collect())
    keyed = _keyed(docs, doc_id, text)
    # Kept in one struct, so the words are cut once.
    prints = let(
        words_of(F.col("text")),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"),
            F.array_distinct(F.concat(F.array().cast("array<bigint>"), *(_prints(w, size) for size in sizes))).alias("prints"),
        ),
    )
    exploded = (
        keyed.select("doc_id", "text_key", prints.alias("p"))
        .select("doc_id", "text_key", F.col("p.n_words").alias("n_words"), F.col("p.prints").alias("prints"))
        .select("doc_id", "text_key", "n_words", F.explode_outer("prints").alias("print"))
    )
    theirs = stored(known.select(F.col("print").alias("theirs")).distinct(), "benchmark-prints")
    counted = stored(
        exploded.join(theirs, F.col("print") == F.col("theirs"), "left")
        .groupBy("doc_id", "text_key")
        .agg(F.max("n_words").alias("n_words"), F.max(F.col("theirs").isNotNull()).alias("met")),
        "meetings",
    )
    met = stored(counted.where("met").select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "met")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    close = keyed.join(met, same, "left_semi")
    hits = None
    for size in sizes:
        spans = _spans(close, size, "doc_id", "text_key").join(known.where(F.col("size") == size).drop("size"), ["print", "span"])
        spans = spans.select("doc_id", "text_key", "size", "at", "item_id")
        hits = spans if hits is None else hits.union(spans)
    if hits is None:  # no item has a word
        none = counted.where(F.lit(False)).select("doc_id", "text_key", F.lit(0).cast("long").alias("n_hit"))
        return counted, none.withColumn("items", F.array().cast("array<bigint>"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["at"], s["at"] + s["size"] - 1))))
    grouped = hits.groupBy("doc_id", "text_key").agg(F.collect_set(F.struct("size", "at")).alias("spans"), F.collect_set(F.struct("item_id")).alias("items"))
    return counted, grouped.select("doc_id", "text_key", F.size(covered).cast("long").alias("n_hit"), F.col("items.item_id").alias("items"))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents without a hit."""
    hit = stored(find_leaks(docs, benchmark, doc_id, text)[1].select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key")), "leaks")
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_key"))
    return docs.join(hit, same, "left_anti")


OP6_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), b AS (
  SELECT item_id, w, least(len(w), 10) AS n FROM (
    SELECT item_id,
           regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
    FROM benchmark) WHERE len(w) > 0
), bw AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT item_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM b)
), dw AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS g
  FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)
), hits AS (
  SELECT dw.r, dw.i, dw.n, bw.item_id FROM dw JOIN bw ON dw.n = bw.n AND dw.g = bw.g
), words AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS p FROM hits) GROUP BY r
), items AS (
  SELECT r, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS joined
  FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY r
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(words.n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(items.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items.joined, '')) AS items_sha256,
       coalesce(words.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""


@query("op6_winnowing_decontamination", OP6_SQL)
def op6_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    counted, leaks = find_leaks(docs, table(spark, sf_dir, "benchmark"))
    names = F.transform("items", lambda i: i.cast("string"))
    digests = leaks.select(
        "doc_id", "text_key", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join(F.array_sort(names), ","), 256).alias("digest")
    )
    key = F.struct(F.col("doc_id"), F.col("text_key"))
    results = stored(
        counted.withColumn("k", key).join(digests.withColumn("k", key).drop("doc_id", "text_key"), "k", "left").select(
            F.col("doc_id").alias("_id"),
            F.col("text_key").alias("_key"),
            "n_words",
            F.coalesce("n_hit", F.lit(0)).alias("n_hit"),
            F.coalesce("n_items", F.lit(0)).alias("n_items"),
            F.coalesce("digest", F.sha2(F.lit(""), 256)).alias("items_sha256"),
            (F.coalesce("n_hit", F.lit(0)) > 0).alias("contaminated"),
        ),
        "leak-rows",
    )
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_key") == F.col("_key"))
    return _keyed(docs, "doc_id", "text").drop("text").join(results, same).drop("_id", "_key", "text_key")
