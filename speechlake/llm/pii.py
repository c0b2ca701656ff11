"""Personal data: patterns, and terms that reveal them.

Four kinds are found by pattern. Their values are the protected entities. The
document that holds an entity is its context; over the whole corpus, the
pointwise mutual information of entity and word, as a share of the entity's own
information content, says how much of the entity the word discloses (1: whoever
reads the word knows the entity). Words that disclose ``GENERALISE_AT`` or more
and were seen in at least ``MIN_CONTEXTS`` different texts are masked in the
documents that hold the entity: generalised to a class of words, or removed
from ``REMOVE_AT`` on.

Everything is column functions: matches and the text between them give code
point offsets, and the counts are two aggregations and equi-joins.

Defined results: null, empty and blank texts have no spans; equal rows get equal
results; copies of a text count as one context but as many documents; an
empty table gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.let import let
from speechlake.llm.common import query, table
from speechlake.sources.scratch import stored

KINDS = ("email", "ip", "card", "phone", "term")
TERM = KINDS.index("term")
# A match may start where the one before ended or where its first character
# class begins, so a long run is read once.
PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++(?:\.[0-9]++){3}",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_BYTE = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[0-9]{1,2})"
_SPAN = "array<struct<start:int,end:int,value:string>>"
_FOUND = "array<struct<start:int,kind:int,end:int,value:string>>"

MIN_CONTEXTS = 2
GENERALISE_AT = 0.95
REMOVE_AT = 0.99


def located(text: Column, pattern: Column) -> Column:
    """``start, end, value`` of all matches, in code points."""
    gaps = F.transform(F.split(text, pattern, F.lit(-1)), F.length)
    steps = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)), gaps, lambda v, gap: F.struct(v.alias("value"), gap.alias("gap"), F.length(v).alias("size"))
    )

    def step(done: Column, x: Column) -> Column:
        start = done["at"] + x["gap"]
        span = F.struct(start.alias("start"), (start + x["size"]).alias("end"), x["value"].alias("value"))
        return F.struct((start + x["size"]).alias("at"), F.array_append(done["spans"], span).alias("spans"))

    start = F.struct(F.lit(0).alias("at"), F.array().cast(_SPAN).alias("spans"))
    return F.aggregate(F.filter(steps, lambda x: x["value"].isNotNull()), start, step, lambda done: done["spans"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _valid(kind: str, value: Column) -> Column:
    size = F.length(_digits(value))
    return {
        "email": F.lit(True),
        "ip": value.rlike(rf"^{_BYTE}(?:\.{_BYTE}){{3}}$"),
        "card": size.between(14, 19) & F.call_function("luhn_check", _digits(value)),
        "phone": size.between(10, 15),
    }[kind]


def _may_hold(kind: str, text: Column) -> Column:
    """A cheap test that every text with a match passes."""
    return {
        "email": F.contains(text, F.lit("@")),
        "ip": text.rlike(r"[0-9]\.[0-9]"),
        "card": text.rlike(r"[0-9](?:[\x20-]?[0-9]){13}"),
        "phone": F.contains(text, F.lit("+")),
    }[kind]


def base_spans(text: Column) -> Column:
    """``start, kind, end, value`` of the patterns' matches, in order."""
    def of(number: int, kind: str) -> Column:
        found = F.filter(located(text, F.lit(PATTERNS[kind])), lambda s: _valid(kind, s["value"]))
        tagged = F.transform(
            found, lambda s: F.struct(s["start"].alias("start"), F.lit(number).alias("kind"), s["end"].alias("end"), s["value"].alias("value"))
        )
        return F.when(_may_hold(kind, text), tagged).otherwise(F.array().cast(_FOUND))

    parts = [of(number, kind) for number, kind in enumerate(KINDS[:TERM])]
    return F.coalesce(F.array_sort(F.concat(*parts)), F.array().cast(_FOUND))


def _keyed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Equal rows have equal keys and equal results."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).alias("text"))


def _words(text: Column) -> Column:
    """The different words of a text, with letters and digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""))


def contexts(keyed: DataFrame) -> DataFrame:
    """``doc_id, text_key, entities`` of the documents that hold entities."""

    def named(s: Column) -> Column:
        name = F.when(s["kind"] == 0, F.lower(s["value"])).otherwise(_digits(s["value"]))
        return F.concat_ws(":", s["kind"].cast("string"), name)

    spans = keyed.select("doc_id", "text_key", base_spans(F.col("text")).alias("spans")).where(F.size("spans") > 0)
    return spans.select("doc_id", "text_key", F.array_distinct(F.transform("spans", named)).alias("entities"))


def disclosing(keyed: DataFrame, seen: DataFrame) -> DataFrame:
    """``entity, term, removed`` of the terms above the threshold.

    ``seen`` are the corpus's contexts. Counts are of documents: ``n`` of the
    corpus, ``n_entity`` with the entity, ``n_term`` with the term and
    ``n_both`` with both.
    """
    texts = seen.groupBy("text_key").agg(F.any_value("entities").alias("entities"), F.count("*").alias("copies"))
    held = stored(texts.select("text_key", "copies", F.explode("entities").alias("entity")), "held")
    entities = stored(
        held.groupBy("entity").agg(F.sum("copies").alias("n_entity"), F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= MIN_CONTEXTS)
        .select("entity", "n_entity"),
        "entities",
    )
    # An entity of fewer texts cannot meet a term in more.
    often = stored(held.join(entities, "entity").groupBy("text_key", "copies").agg(F.collect_list("entity").alias("entities")), "often")
    known = keyed.join(often.select("text_key"), "text_key", "left_semi").groupBy("text_key").agg(F.any_value("text").alias("text"))
    pairs = often.join(known.select("text_key", _words(F.col("text")).alias("terms")), "text_key")
    pairs = pairs.select("copies", "terms", F.explode("entities").alias("entity")).select("copies", "entity", F.explode("terms").alias("term"))
    both = stored(pairs.groupBy("entity", "term").agg(F.sum("copies").alias("n_both"), F.count("*").alias("n_contexts")).where(F.col("n_contexts") >= MIN_CONTEXTS), "both")
    counts = stored(keyed.select(F.explode(_words(F.col("text"))).alias("term")).groupBy("term").agg(F.count("*").alias("n_term")), "terms")
    total = keyed.agg(F.count("*").alias("n"))
    content = -F.log2(F.col("n_entity") / F.col("n"))
    shared = F.log2(F.col("n_both") * F.col("n") / (F.col("n_entity") * F.col("n_term")))
    return (
        both.join(counts, "term")
        .join(entities, "entity")
        .join(F.broadcast(total))  # one row
        .where((content > 0) & (shared >= GENERALISE_AT * content))
        .select("entity", "term", (shared >= REMOVE_AT * content).alias("removed"))
    )


def revealing_terms(keyed: DataFrame) -> DataFrame:
    """``doc_id, text_key, terms``: what else must go from documents that hold
    an entity; a term that is removed for one entity is removed."""
    seen = stored(contexts(keyed), "contexts")
    chosen = stored(disclosing(keyed, seen), "disclosing")
    held = seen.select("doc_id", "text_key", F.explode("entities").alias("entity")).distinct()
    terms = held.join(chosen, "entity").groupBy("doc_id", "text_key", "term").agg(F.max("removed").alias("removed"))
    return terms.groupBy("doc_id", "text_key").agg(F.collect_list(F.struct("term", "removed")).alias("terms"))


def all_spans(text: Column, base: Column, terms: Column) -> Column:
    """Base spans and those of the terms, without terms inside base spans."""
    words = F.array_join(F.transform(terms, lambda t: t["term"]), "|")
    pattern = F.concat(F.lit(r"(?iu)(?<![\p{L}\p{N}])(?:"), words, F.lit(r")(?![\p{L}\p{N}])"))
    free = F.filter(located(text, pattern), lambda s: ~F.exists(base, lambda b: (b["start"] < s["end"]) & (s["start"] < b["end"])))
    tagged = F.transform(free, lambda s: F.struct(s["start"].alias("start"), F.lit(TERM).alias("kind"), s["end"].alias("end"), s["value"].alias("value")))
    return F.when(terms.isNull(), base).otherwise(F.array_sort(F.concat(base, tagged)))


def with_spans(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with ``_base``, ``_terms`` and ``_spans``."""
    terms = stored(revealing_terms(_keyed(docs, doc_id, text)), "revealing")
    terms = terms.select(F.col("doc_id").alias("_id"), F.col("text_key").alias("_key"), F.col("terms").alias("_terms"))
    same = F.col(doc_id).eqNullSafe(F.col("_id")) & (F.xxhash64(F.col(text)) == F.col("_key"))
    found = let(
        base_spans(F.col(text)), lambda base: F.struct(base.alias("_base"), all_spans(F.col(text), base, F.col("_terms")).alias("_spans"))
    )
    return docs.join(terms, same, "left").withColumn("_found", found).select(*docs.columns, "_terms", "_found._base", "_found._spans")


def sanitised(text: Column, spans: Column, terms: Column) -> Column:
    """The text with every span replaced by its class in brackets, and terms
    that must be removed by nothing. The union of overlapping spans is masked."""
    gone = F.transform(F.filter(terms, lambda t: t["removed"]), lambda t: t["term"])
    labels = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS[:TERM]), F.lit("[WORD]"))

    def step(done: Column, s: Column) -> Column:
        label = F.when((s["kind"] == TERM) & F.coalesce(F.array_contains(gone, F.lower(s["value"])), F.lit(False)), "").otherwise(F.get(labels, s["kind"]))
        gap = F.greatest(s["start"] - done["at"], F.lit(0))
        parts = F.concat(done["parts"], F.array(F.substring(text, done["at"] + 1, gap), label))
        return F.when(s["end"] <= done["at"], done).otherwise(F.struct(s["end"].alias("at"), parts.alias("parts")))

    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("parts"))
    rest = lambda done: F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"] + 1, F.length(text)))
    return F.when(F.size(spans) == 0, text).otherwise(F.aggregate(spans, start, step, rest))


def sanitise(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents with personal data and revealing terms masked."""
    clean = with_spans(docs, doc_id, text).withColumn(text, sanitised(F.col(text), F.col("_spans"), F.col("_terms")))
    return clean.select(*docs.columns)


def _joined(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["kind"]), s["start"], s["end"])), ",")


@query("op4_pii_sanitisation")
def op4_pii_sanitisation(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = with_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    number = lambda n: F.size(F.filter("_base", lambda s: s["kind"] == n)).cast("long")
    return found.select(
        "doc_id",
        *(number(n).alias(f"n_{kind}") for n, kind in enumerate(KINDS[:TERM])),
        F.sha2(_joined(F.col("_base")), 256).alias("base_sha256"),
        _joined(F.col("_spans")).alias("spans"),
    )
