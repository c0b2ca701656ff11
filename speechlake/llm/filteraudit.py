"""How five filters interact, over all their orders, from one pass of a stream.

The files of a table are processed as available-now micro-batches. A document
is known by the mask of the filters it fails. Four of them look at the text
alone; the fifth fails documents whose text a smaller id has as well, so it can
change when a smaller id arrives. Keyed state holds, per text (by its digest),
the smallest id so far and the masks of the rows that carry it. A smaller id
takes their place: their masks are retracted from the counters of their part and
counted again with the fifth filter failed. Every micro-batch writes what it
adds to the counters (part, mask, labels) to a folder of its own, so a repeated
batch replaces itself, and a stream that is started again over more files goes
on where it stopped. Orders, steps and Shapley sums come from the counters: at
most 128 per part.

Digests are kept in buckets of about ``TEXTS`` texts, so that a state row is
worked on with vectors; their number is set when a stream starts first. Rows of
one text are merged in each task before the shuffle, so a text of very many
copies is a few rows per task.

Defined results: a null text is empty; a null ``lang`` is the part ``''``, the
same as an empty one; a null id is neither smaller nor larger than another, so
such rows never fail the fifth filter and never make others fail it; rows of the
same text and id don't fail each other; repeated label rows count as one, a
label holds where any of them says 1; an empty table gives no rows; other
columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations
from math import factorial

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from speechlake.llm.common import BLANK, UPPER, query, ship, table
from speechlake.sources.scratch import scratch_path, stored
from speechlake.streaming.running import file_stream

FILTERS = "ABCDE"
# Bits of a mask beside those of the filters.
_COPY, _GOOD, _TOXIC = 1 << 4, 1 << 5, 1 << 6
# Micro-batches of a first run, if there are as many files.
BATCHES = 4
# Texts of a bucket of the state, on average.
TEXTS = 512

_ROW = "bucket long, digest binary, doc_id long, part string, bits int, n long, held boolean"
_COUNTS = "part string, bits int, n long"


def failures(text: Column) -> Column:
    """Bits of the four filters that look at one text."""
    words = F.array_remove(F.split(text, BLANK), "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.translate(text, UPPER, ""))
    failed = [n < 100, 100 * distinct < 80 * n, 100 * capitals > 10 * F.length(text), text.rlike("[#$%&*|]")]
    return sum((F.when(f, 1 << k).otherwise(0) for k, f in enumerate(failed)), F.lit(0))


def masked(docs: DataFrame, labels: DataFrame, buckets: int) -> DataFrame:
    """``bucket, digest, doc_id, part, bits, free`` of every document; ``labels``
    has one row per id. ``free`` rows have no id."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    digest = F.unhex(F.md5(text))
    rows = docs.select(
        F.pmod(F.xxhash64(digest), F.lit(buckets)).alias("bucket"),
        digest.alias("digest"),
        F.col("doc_id").cast("long").alias("_id"),
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"),
        failures(text).alias("_own"),
    )
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), F.col("bits").alias("_labels"))
    bits = F.col("_own") + F.coalesce("_labels", F.lit(0))
    return rows.join(known, "_id", "left").select(
        "bucket", "digest", F.coalesce("_id", F.lit(0)).alias("doc_id"), "part", bits.cast("int").alias("bits"), F.col("_id").isNull().alias("free")
    )


def label_bits(labels: DataFrame) -> DataFrame:
    """``doc_id, bits`` of the labels, one row per id."""
    bit = lambda name, value: F.when(F.max(F.when(F.col(name) == 1, 1).otherwise(0)) == 1, value).otherwise(0)
    return labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg((bit("quality", _GOOD) + bit("toxic", _TOXIC)).alias("bits"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of equal texts are put together: those of the smallest id are
    ``held``, the others have their final mask."""
    for batch in batches:
        rows = batch.to_pandas()
        yield pa.RecordBatch.from_pandas(_merge(rows), _merged_schema, preserve_index=False)


_merged_schema = pa.schema(
    [("bucket", pa.int64()), ("digest", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("bits", pa.int32()), ("n", pa.int64()), ("held", pa.bool_())]
)


def _merge(rows: pd.DataFrame) -> pd.DataFrame:
    named = rows[~rows["free"]]
    least = named.groupby("digest")["doc_id"].transform("min")
    held = (named["doc_id"] == least).reindex(rows.index, fill_value=False)
    bits = rows["bits"].where(rows["free"] | held, rows["bits"] | _COPY)
    keys = {"bucket": rows["bucket"], "digest": rows["digest"], "doc_id": rows["doc_id"].where(held, 0), "part": rows["part"], "bits": bits, "held": held}
    return pd.DataFrame(keys).groupby(list(keys), sort=False).size().rename("n").reset_index()


_STATE = ["digest", "doc_id", "part", "bits", "n"]
_state_schema = pa.schema([_merged_schema.field(n) for n in _STATE])


def _packed(rows: pd.DataFrame) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, _state_schema) as out:
        out.write_table(pa.Table.from_pandas(rows[_STATE], _state_schema, preserve_index=False))
    return sink.getvalue().to_pybytes()


def updated(old: pd.DataFrame | None, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
    """The state of a bucket after new rows, and what they change in the
    counters (``part, bits, n``)."""
    fresh = rows[rows["held"]]
    both = pd.concat([x[_STATE].assign(old=was) for x, was in ((old, True), (fresh, False)) if x is not None and len(x)] or [rows[_STATE].assign(old=False)[:0]])
    stays = both["doc_id"] == both.groupby("digest")["doc_id"].transform("min")
    kept, gone = both[stays], both[~stays]
    copies = gone.assign(bits=gone["bits"] | _COPY)
    retracted = gone[gone["old"]]
    changes = pd.concat([x[["part", "bits", "n"]] for x in (rows[~rows["held"]], kept[~kept["old"]], copies, retracted.assign(n=-retracted["n"]))])
    state = kept.groupby(["digest", "doc_id", "part", "bits"], sort=False)["n"].sum().reset_index()
    return state, changes.groupby(["part", "bits"], sort=False)["n"].sum().reset_index()


def _update(key: tuple, frames: Iterable[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
    rows = pd.concat(frames)
    old = pa.ipc.open_stream(state.get[0]).read_all().to_pandas() if state.exists else None
    new, changes = updated(old, rows)
    if len(rows[rows["held"]]):
        state.update((_packed(new),))
    yield changes


def run_counters(spark: SparkSession, path: str, labels: DataFrame, out: str, buckets: int, files_per_batch: int) -> None:
    """Process the files below ``path`` that ``out`` has not seen yet."""
    # A pattern, as a stream takes a plain path for a folder; the table may be one file.
    stream = file_stream(spark, f"{path[:-1]}[{path[-1]}]", spark.read.parquet(path).schema, files_per_batch)
    rows = masked(stream, labels, buckets).mapInArrow(_merged, _ROW)
    changes = rows.groupBy("bucket").applyInPandasWithState(_update, _COUNTS, "rows binary", "append", GroupStateTimeout.NoTimeout)

    def save(batch: DataFrame, batch_id: int) -> None:
        batch.groupBy("part", "bits").agg(F.sum("n").alias("n")).write.mode("overwrite").parquet(f"{out}/counters/batch={batch_id}")

    writer = changes.writeStream.outputMode("append").foreachBatch(save)
    writer.option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()


def counters(spark: SparkSession, out: str) -> DataFrame:
    """``part, bits, n`` of all micro-batches."""
    found = spark.read.schema(_COUNTS).parquet(f"{out}/counters")
    return found.groupBy("part", "bits").agg(F.sum("n").alias("n")).where("n <> 0")


def audit(counts: DataFrame) -> DataFrame:
    """A row per part, order of the filters and step."""
    spark = counts.sparkSession
    cases, steps = [], []
    for k, letter in enumerate(FILTERS):
        for earlier in range(1 << len(FILTERS)):
            if not earlier >> k & 1:
                before = bin(earlier).count("1")
                weight = factorial(before) * factorial(len(FILTERS) - 1 - before)
                cases.append(f"named_struct('letter', '{letter}', 'own', {1 << k}, 'earlier', {earlier}, 'weight', {weight})")
    for order in permutations(FILTERS):
        for step, letter in enumerate(order, 1):
            steps.append(("".join(order), step, letter, sum(1 << FILTERS.index(x) for x in order[: step - 1])))
    case = counts.withColumn("c", F.explode(F.expr(f"array({', '.join(cases)})"))).select("part", "bits", "n", "c.*")
    mask = F.col("bits").bitwiseAND(31)
    fails, before = mask.bitwiseAND(F.col("own")) != 0, mask.bitwiseAND(F.col("earlier")) != 0
    total = lambda which: F.sum(F.when(which, F.col("n")).otherwise(0))
    met = case.groupBy("part", "letter", "earlier", "weight").agg(
        total(~fails & ~before).alias("kept"),
        total(fails & ~before).alias("removed"),
        total(fails & before).alias("redundant"),
        total(mask == F.col("own")).alias("unique_fails"),
        total(fails & ~before & (F.col("bits").bitwiseAND(_GOOD) != 0)).alias("good_lost"),
        total(fails & ~before & (F.col("bits").bitwiseAND(_TOXIC) != 0)).alias("toxic_lost"),
    )
    met = stored(met, "audit-cases")
    shapley = met.groupBy("part", "letter").agg(F.sum(F.col("weight") * F.col("removed")).alias("shapley"))
    orders = spark.createDataFrame(steps, "filter_order string, step int, letter string, earlier int")
    names = ["kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    joined = met.drop("weight").join(shapley, ["part", "letter"]).join(F.broadcast(orders), ["letter", "earlier"])
    return joined.select("part", "filter_order", "step", *names)


def run_audit(spark: SparkSession, path: str, labels: DataFrame) -> DataFrame:
    """The audit of a whole table at ``path``, in about ``BATCHES`` micro-batches."""
    ship(spark)
    docs = spark.read.parquet(path)
    files = len(docs.inputFiles())
    out = scratch_path(spark, "audit")
    run_counters(spark, path, stored(label_bits(labels), "label-bits"), out, max(docs.count() // TEXTS, 1), max(-(-files // BATCHES), 1))
    return audit(counters(spark, out))


_SQL = r"""
WITH RECURSIVE letters(letter, own) AS (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)),
orders(filter_order, mask) AS (
  SELECT letter, own FROM letters
  UNION ALL
  SELECT filter_order || letter, mask + own FROM orders, letters WHERE mask & own = 0),
steps AS (
  SELECT filter_order, step, own,
         (SELECT coalesce(sum(l.own), 0) FROM letters l WHERE strpos(filter_order, l.letter) < step)::INT AS earlier
  FROM (SELECT filter_order FROM orders WHERE mask = 31), (SELECT unnest(range(1, 6)) AS step), letters
  WHERE substr(filter_order, step, 1) = letter),
marked AS (SELECT doc_id, max((quality = 1)::INT) AS good, max((toxic = 1)::INT) AS toxic FROM labels GROUP BY doc_id),
texts AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents),
least AS (SELECT t, min(doc_id) AS first_id FROM texts GROUP BY t),
masks AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
         (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
         + 4 * (100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 10 * len(t))::INT
         + 8 * regexp_matches(t, '[#$%&*|]')::INT + 16 * coalesce(first_id < doc_id, false)::INT AS mask
  FROM texts JOIN least USING (t) LEFT JOIN marked USING (doc_id)),
counted AS (
  SELECT part, own, earlier,
         count(*) FILTER (mask & (own | earlier) = 0) AS kept,
         count(*) FILTER (mask & own > 0 AND mask & earlier = 0) AS removed,
         count(*) FILTER (mask & own > 0 AND mask & earlier > 0) AS redundant,
         count(*) FILTER (mask = own) AS unique_fails,
         count(*) FILTER (mask & own > 0 AND mask & earlier = 0 AND good = 1) AS good_lost,
         count(*) FILTER (mask & own > 0 AND mask & earlier = 0 AND toxic = 1) AS toxic_lost
  FROM masks, (SELECT DISTINCT own, earlier FROM steps) GROUP BY ALL)
SELECT part, filter_order, step::INT AS step, kept, removed, redundant, unique_fails, good_lost, toxic_lost,
       sum(removed) OVER (PARTITION BY part, own)::BIGINT AS shapley
FROM counted JOIN steps USING (own, earlier)"""


@query("op13_filter_interaction_audit", _SQL)
def op13_filter_interaction_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_audit(spark, f"{sf_dir}/documents.parquet", table(spark, sf_dir, "labels"))
