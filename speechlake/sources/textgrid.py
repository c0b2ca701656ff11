"""Praat text annotation files: a corpus scan and a corpus sink."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

_NUMBER = r"[-+]?\d+(?:\.\d+)?(?:[eE][-+]?\d+)?"
_ITEM = r"(?m)^[ \t]*item\s*\[\d+\]\s*:[ \t]*$"
_BLOCK = (
    rf"(?m)^[ \t]*intervals\s*\[\d+\]\s*:\s*xmin\s*=[^\n]*?({_NUMBER})[^\n]*"
    rf"\s+xmax\s*=[^\n]*?({_NUMBER})[^\n]*"
    r'\s+text\s*=\s*"([^\n]*)"[ \t]*$'
)


def _value(text: Column, name: str) -> Column:
    """First number after ``name =`` at the start of a line."""
    return F.regexp_extract(text, rf"(?m)^[ \t]*{name}\s*=[^\n]*?({_NUMBER})", 1).try_cast("double")


def _quoted(text: Column, name: str) -> Column:
    found = F.regexp_extract(text, rf'(?m)^[ \t]*{name}\s*=\s*"([^\n]*)"[ \t]*$', 1)
    return F.when(text.rlike(rf'(?m)^[ \t]*{name}\s*=\s*"'), found)


def _tier(part: Column) -> Column:
    group = lambda g: F.regexp_extract_all(part, F.lit(_BLOCK), F.lit(g))
    return F.struct(
        _quoted(part, "class").alias("class"),
        _quoted(part, "name").alias("name"),
        _value(part, "xmin").alias("xmin"),
        _value(part, "xmax").alias("xmax"),
        F.regexp_extract(part, r"intervals:\s*size\s*=\s*(\d+)", 1).try_cast("int").alias("declared"),
        F.regexp_count(part, F.lit(r"(?m)^[ \t]*intervals\s*\[\d+\]\s*:[ \t]*$")).alias("blocks"),
        F.arrays_zip(
            F.transform(group(1), lambda x: x.cast("double")).alias("xmin"),
            F.transform(group(2), lambda x: x.cast("double")).alias("xmax"),
            group(3).alias("label"),
        ).alias("intervals"),
    )


def _tier_error(tier: Column) -> Column:
    lacks = tier["class"].isNull() | tier["name"].isNull() | tier["xmin"].isNull() | tier["xmax"].isNull()
    n = F.size(tier["intervals"])
    return (
        F.when(lacks, F.lit("malformed tier: class, name, xmin or xmax is missing"))
        .when(tier["class"] != "IntervalTier", F.concat(F.lit("unsupported tier class "), tier["class"]))
        .when(tier["blocks"] != n, F.lit("malformed interval"))
        .when(tier["declared"] != n, F.lit("interval count mismatch"))
    )


def parse_documents(docs: DataFrame) -> DataFrame:
    """Parse whole documents (path, value) to (path, error, xmin, xmax, tiers)."""
    text = F.regexp_replace("value", r"\r\n?", "\n")
    parts = F.split(F.col("_text"), _ITEM)
    parsed = docs.select("path", text.alias("_text")).select(
        "path",
        "_text",
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), _tier).alias("tiers"),
        _value(F.col("_text"), "xmin").alias("xmin"),
        _value(F.col("_text"), "xmax").alias("xmax"),
    )
    head = F.substring_index(F.col("_text"), "\n", 10)
    size = F.regexp_extract(F.col("_text"), r"(?s)tiers\? <exists>.*?\n[ \t]*size\s*=\s*(\d+)", 1).try_cast("int")
    first_bad = F.get(F.filter(F.transform("tiers", _tier_error), lambda e: e.isNotNull()), F.lit(0))
    error = (
        F.when(~head.rlike(r'Object class[^\n]*TextGrid'), F.lit("not an annotation file"))
        .when(F.col("xmin").isNull() | F.col("xmax").isNull(), F.lit("no global xmin or xmax"))
        .when(size.isNull(), F.lit("no tier count"))
        .when(F.size("tiers") == 0, F.lit("no tiers"))
        .otherwise(first_bad)
    )
    return parsed.select("path", error.alias("error"), "xmin", "xmax", "tiers")


def document_intervals(parsed: DataFrame) -> DataFrame:
    """Interval table of the accepted documents; empty tiers keep one row with a null idx."""
    tiers = parsed.where("error is null").select("path", F.posexplode("tiers").alias("tier_no", "tier"))
    return tiers.select(
        "path", "tier_no", F.col("tier.name").alias("tier"), F.posexplode_outer("tier.intervals").alias("idx", "i")
    ).select("path", "tier_no", "tier", "idx", "i.xmin", "i.xmax", "i.label")


def rejected_documents(parsed: DataFrame) -> DataFrame:
    return parsed.where("error is not null").select("path", "error")


def read_textgrids(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """Scan annotation files, one row per file (a file is one document)."""
    docs = spark.read.options(**options).text(path, wholetext=True)
    return parse_documents(docs.select("value", F.col("_metadata.file_path").alias("path")))


def praat_number(x: Column) -> Column:
    """At most six decimals, no trailing zeros."""
    whole = F.abs(x - F.round(x)) < 1e-12
    return F.when(whole, F.round(x).cast("long").cast("string")).otherwise(
        F.regexp_replace(F.format_string("%.6f", x), r"\.?0+$", "")
    )


def _lines(rows: list[Column]) -> Column:
    return F.posexplode(F.array(*rows)).alias("k", "line")


def document_tiers(parsed: DataFrame) -> DataFrame:
    """Header table of the accepted documents: their bounds and, in order, their tiers."""
    kept = parsed.where("error is null").withColumnsRenamed({"xmin": "doc_xmin", "xmax": "doc_xmax"})
    tiers = kept.select("path", "doc_xmin", "doc_xmax", F.posexplode("tiers").alias("tier_no", "t"))
    return tiers.select("path", "doc_xmin", "doc_xmax", "tier_no", F.col("t.name").alias("tier"), F.col("t.xmin").alias("xmin"), F.col("t.xmax").alias("xmax"))


def tiers_of(intervals: DataFrame) -> DataFrame:
    """Header table for intervals (utt, tier, …) that come without one: tiers in
    the order of their names, bounds from the intervals."""
    tiers = intervals.groupBy("utt", "tier").agg(F.min("xmin").alias("xmin"), F.max("xmax").alias("xmax"))
    files = tiers.groupBy("utt").agg(F.min("xmin").alias("doc_xmin"), F.max("xmax").alias("doc_xmax"))
    number = F.row_number().over(Window.partitionBy("utt").orderBy("tier")) - 1
    return tiers.withColumn("tier_no", number).join(files, "utt").select("utt", "doc_xmin", "doc_xmax", "tier_no", "tier", "xmin", "xmax")


def textgrid_lines(tiers: DataFrame, intervals: DataFrame) -> DataFrame:
    """Canonical text as ordered lines: (utt, tier_no, idx, k, line).

    ``tiers`` is a header table (utt, doc_xmin, doc_xmax, tier_no, tier, xmin,
    xmax), ``intervals`` is (utt, tier_no, idx, xmin, xmax, label). Header lines
    have tier_no or idx -1 and sort first, so no document is gathered in one row.
    """
    # The lines of the format.
    text = lambda *cols: F.concat(*[F.lit(c) if isinstance(c, str) else c for c in cols])
    num = lambda c: praat_number(F.col(c))
    whole = lambda c: F.col(c).cast("string")
    intervals = intervals.where("idx is not null")
    sizes = intervals.groupBy("utt", "tier_no").agg(F.count("idx").alias("n"))
    sized = tiers.join(sizes, ["utt", "tier_no"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    files = tiers.groupBy("utt").agg(F.min("doc_xmin").alias("xmin"), F.max("doc_xmax").alias("xmax"), F.count(F.lit(1)).alias("n"))
    top = files.select(
        "utt", F.lit(-1).alias("tier_no"), F.lit(-1).alias("idx"),
        _lines([
            F.lit('File type = "ooTextFile"'), F.lit('Object class = "TextGrid"'), F.lit(""),
            text("xmin = ", num("xmin"), " "), text("xmax = ", num("xmax"), " "), F.lit("tiers? <exists> "),
            text("size = ", whole("n"), " "), F.lit("item []: "),
        ]),
    )
    heads = sized.select(
        "utt", "tier_no", F.lit(-1).alias("idx"),
        _lines([
            text("    item [", (F.col("tier_no") + 1).cast("string"), "]:"), F.lit('        class = "IntervalTier" '),
            text('        name = "', F.col("tier"), '" '),
            text("        xmin = ", num("xmin"), " "), text("        xmax = ", num("xmax"), " "),
            text("        intervals: size = ", whole("n"), " "),
        ]),
    )
    body = intervals.select(
        "utt", "tier_no", "idx",
        _lines([
            text("        intervals [", (F.col("idx") + 1).cast("string"), "]:"),
            text("            xmin = ", num("xmin"), " "), text("            xmax = ", num("xmax"), " "),
            text('            text = "', F.replace("label", F.lit('"'), F.lit('\\"')), '" '),
        ]),
    )
    return top.unionByName(heads).unionByName(body)


def write_textgrids(tiers: DataFrame, intervals: DataFrame, path: str) -> None:
    """One folder and one file per utterance, whatever its size.

    A document is one range key, so one task streams its sorted lines to its
    file; the sort spills, nothing is gathered.
    """
    lines = textgrid_lines(tiers, intervals)
    ordered = lines.repartitionByRange("utt").sortWithinPartitions("utt", "tier_no", "idx", "k")
    ordered.select("utt", "line").write.partitionBy("utt").mode("overwrite").text(path)
