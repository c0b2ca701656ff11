"""URL filters: rules first, then naive Bayes over segmented names.

A url is judged by the longest rule that fits its host and path. Where none
fits, its host labels are split into words (Viterbi over unigram counts of the
documents; an unknown word of k letters counts as ``10 / 10**k`` words), and a
multinomial naive Bayes model scores these words and the words of the path. The
model is trained on all urls; its labels are seed words: a url with one of them
counts as unwanted.

Defined results: a null url, or one without ``://``, has an empty host and path,
no rule and no words, so the prior decides; equal urls get equal verdicts;
repeated rows count as often as they occur; an empty table gives no rows; other
columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import ascii_lower, query, table
from speechlake.llm.pieces import best_path, substrings_of
from speechlake.sources.scratch import stored

# Verdict, host and path of the rules.
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)
# Words that mark a url as unwanted when the model is trained.
SEEDS = ("adult", "ads", "bets", "casino", "loan", "pills", "poker", "porn", "spam", "viagra", "xxx")
LONGEST = 24


def host_and_path(url: Column) -> tuple[Column, Column]:
    pattern = r"(?s)^.*?://([^/?#]*)([^?#]*)"
    part = lambda n: F.coalesce(F.regexp_extract(url, pattern, n), F.lit(""))
    return ascii_lower(part(1)), part(2)


def rule_verdicts(urls: DataFrame, rules=RULES) -> DataFrame:
    """``key, rule, rule_verdict`` of the longest rule that fits, if any does."""
    spark = urls.sparkSession
    known = spark.createDataFrame([(v, h, p, h + p) for v, h, p in rules], "rule_verdict string, rule_host string, rule_path string, rule string")
    deepest = max((h.count(".") + 1 for _, h, _ in rules), default=1)
    labels = F.split("host", r"\.")
    ends = F.array_distinct(F.array(*(F.array_join(F.slice(labels, -F.least(F.lit(k), F.size(labels)), k), ".") for k in range(1, deepest + 1))))
    fits = urls.select("key", "path", F.explode(ends).alias("rule_host")).join(known, "rule_host").where(F.startswith("path", F.col("rule_path")))
    order = F.struct(F.length("rule").alias("size"), "rule_verdict", "rule")
    return fits.groupBy("key").agg(F.max(order).alias("best")).select("key", "best.rule", "best.rule_verdict")


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``piece, n``: words of ASCII letters in lower case."""
    words = F.split(F.lower(F.coalesce(F.col(text), F.lit(""))), "[^a-z]+")
    return docs.select(F.explode(words).alias("piece")).where("piece <> ''").groupBy("piece").agg(F.count("*").alias("n"))


def segmented(labels: DataFrame, words: DataFrame) -> DataFrame:
    """``label, words`` for the distinct ``label``, by unigram Viterbi."""
    units = stored(labels.select(F.monotonically_increasing_id().alias("uid"), F.col("label").alias("unit"), F.lit(1).alias("n")), "labels")
    total = words.agg(F.sum("n").alias("total"))  # one row
    edges = substrings_of(units, LONGEST).join(words.select("piece", F.col("n").alias("times")), "piece", "left").join(F.broadcast(total))
    size = F.col("end") - F.col("start")
    unknown = F.log(F.lit(10.0)) - size * F.log(F.lit(10.0))
    # Sums of scores are compared after rounding to 2**-20, so their order cannot matter.
    score = F.round((F.coalesce(F.log(F.col("times").cast("double")), unknown) - F.log(F.coalesce("total", F.lit(1)) + 1.0)) * 2**20) / 2**20
    edges = edges.select("uid", "unit", F.struct("end", "start", size.alias("id"), score.alias("score")).alias("edge"))
    grouped = edges.groupBy("uid").agg(F.collect_list("edge").alias("edges"), F.max("unit").alias("label"))

    def take(state: Column, size: Column) -> Column:
        word = F.substring(F.col("label"), state["at"] + 1, size)
        return F.struct((state["at"] + size).alias("at"), F.array_append(state["words"], word).alias("words"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("words"))
    return grouped.select("label", best_path(F.col("edges")).alias("sizes")).select("label", F.aggregate("sizes", start, take, lambda s: s["words"]).alias("words"))


def _words(text: Column) -> Column:
    return F.filter(F.split(ascii_lower(text), "[^a-z]+"), lambda w: w != "")


def tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``key, n, token``: segmented words of the host, words of the path."""
    labels = stored(urls.select("key", "n", F.explode(_words(F.col("host"))).alias("label")), "host-labels")
    split = stored(segmented(labels.select("label").distinct(), words), "segmented")
    hosts = labels.join(split, "label").select("key", "n", F.explode("words").alias("token"))
    return hosts.union(urls.select("key", "n", F.explode(_words(F.col("path"))).alias("token")))


def bayes_verdicts(urls: DataFrame, found: DataFrame, seeds=SEEDS) -> DataFrame:
    """``key, unwanted``: naive Bayes with add-one smoothing.

    Per token ``weight`` is the log likelihood ratio of the two classes.
    """
    marked = found.where(F.col("token").isin(*seeds)).select("key").distinct().withColumn("bad", F.lit(1))
    labelled = stored(marked, "marked")
    sides = urls.join(labelled, "key", "left").agg(
        F.sum("n").alias("n_all"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("n_bad")
    )
    counts = stored(
        found.join(labelled, "key", "left")
        .groupBy("token")
        .agg(F.sum("n").alias("times"), F.sum(F.when(F.col("bad") == 1, F.col("n")).otherwise(0)).alias("times_bad")),
        "token-counts",
    )
    sums = counts.agg(F.sum("times").alias("t"), F.sum("times_bad").alias("t_bad"), F.count("*").alias("kinds"))
    good = (F.col("times") - F.col("times_bad") + 1) / (F.col("t") - F.col("t_bad") + F.col("kinds"))
    bad = (F.col("times_bad") + 1) / (F.col("t_bad") + F.col("kinds"))
    weights = stored(counts.join(F.broadcast(sums)).select("token", F.log(bad / good).alias("weight")), "weights")
    scores = found.join(weights, "token").groupBy("key").agg(F.sum("weight").alias("score"))
    prior = sides.select(F.log((F.col("n_bad") + 1) / (F.col("n_all") - F.col("n_bad") + 1)).alias("prior"))
    # Both broadcast tables are one row.
    return urls.select("key").join(stored(scores, "scores"), "key", "left").join(F.broadcast(prior)).select(
        "key", (F.coalesce("score", F.lit(0.0)) + F.coalesce("prior", F.lit(0.0)) > 0).alias("unwanted")
    )


def judged(pages: DataFrame, words: DataFrame, url: str = "url") -> DataFrame:
    """The pages with ``host, path, rule, verdict``."""
    distinct = pages.groupBy(F.coalesce(F.col(url), F.lit("")).alias("key")).agg(F.count("*").alias("n"))
    host, path = host_and_path(F.col("key"))
    urls = stored(distinct.select("key", "n", host.alias("host"), path.alias("path")), "urls")
    found = stored(tokens(urls, words), "tokens")
    ruled = stored(rule_verdicts(urls), "ruled")
    verdict = F.coalesce("rule_verdict", F.when(F.col("unwanted"), "block").otherwise("allow"))
    known = stored(
        urls.join(ruled, "key", "left")
        .join(stored(bayes_verdicts(urls, found), "bayes"), "key", "left")
        .select(F.col("key").alias("_key"), "host", "path", "rule", verdict.alias("verdict")),
        "verdicts",
    )
    own = pages.drop("host", "path", "rule", "verdict")
    return own.join(known, F.coalesce(F.col(url), F.lit("")) == F.col("_key")).drop("_key")


@query("op10_url_filters")
def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = stored(word_counts(table(spark, sf_dir, "documents")), "word-counts")
    return judged(table(spark, sf_dir, "pages").select("page_id", "url"), words).drop("url")
