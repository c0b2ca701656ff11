"""Language-model scores: bigrams with stupid backoff over the whole corpus.

The score of a word after its predecessor is ``c(ab) / c(a)`` where the corpus
holds the pair at least ``MIN_COUNT`` times (a pair seen once is the document's
own), else ``BACKOFF * c(b) / N``; a first word scores ``c(b) / N``. A
document's score is the sum of the base-2 logarithms.

Words are 64-bit hashes. The pairs of a block of documents go out once, in
packed lists per bucket: a bucket holds all pairs of its hash, so it counts and
scores them in place. The most frequent ``HOT_WORDS`` words (a fixed number)
and their counts are broadcast; pairs after such a word are dealt by the whole
pair, so no frequent word meets in one bucket, all other pairs by their first
word, so that its count is at hand. Words that back off and are not in the
broadcast table meet the count table in a join. The sums return in packed lists
per block.

Defined results: null, empty and blank texts have no words and score 0; equal
rows score alike and all count; an empty table gives no rows; other columns are
not looked at. Scores are summed in steps of ``2**-20``, so their order cannot
matter.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import BLANK, ascii_lower, most_frequent, query, ship, table
from speechlake.sources.scratch import stored

MIN_COUNT = 2
BACKOFF = 0.4
HOT_WORDS = 262144
# Pairs that a bucket should hold, and documents (a 16-bit index) and words of
# one block; a longer document is a block of its own.
BUCKET = 1_000_000
BLOCK = 30_000
BLOCK_WORDS = 800_000
UNIT = 2**20
# All word hashes have bit 62, so the start mark is no word.
_WORD_BIT, _START = 1 << 62, 0


def _hashed(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    words = F.array_remove(F.split(ascii_lower(F.coalesce(F.col(text), F.lit(""))), BLANK), "")
    return docs.select(F.col(doc_id).alias("doc_id"), F.transform(words, lambda w: F.xxhash64(w).bitwiseOR(F.lit(_WORD_BIT))).alias("words"))


def _lists(column: pa.ListArray) -> tuple[np.ndarray, np.ndarray]:
    """Ends (from 0) and values of a list column."""
    ends = column.offsets.to_numpy()
    return ends - ends[0], column.flatten().to_numpy(zero_copy_only=False)


def _mixed(keys: np.ndarray) -> np.ndarray:
    keys = keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9) >> np.uint64(20)


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``word, n, n_before``: how often a word occurs, and before another."""
    for batch in batches:
        ends, values = _lists(batch.column(0))
        last = values[ends[1:][np.diff(ends) > 0] - 1]
        words, n = np.unique(values, return_counts=True)
        ending = np.zeros(len(words), np.int64)
        np.add.at(ending, np.searchsorted(words, last), 1)
        yield pa.RecordBatch.from_arrays([pa.array(words), pa.array(n), pa.array(n - ending)], ["word", "n", "n_before"])


class _Hot:
    """The broadcast words in order, with their counts."""

    def __init__(self, rows: list, total: int):
        rows = sorted((r.word, r.n, r.n_before) for r in rows)
        self.words, self.n, self.n_before = (np.array([r[k] for r in rows], np.int64) for k in range(3))
        self.total = total

    def find(self, words: np.ndarray) -> np.ndarray:
        """Places of the words, -1 for others."""
        if not len(self.words):
            return np.full(len(words), -1, np.int64)
        at = np.searchsorted(self.words, words)
        at[at == len(self.words)] = 0
        return np.where(self.words[at] == words, at, -1)


# Places of words in the broadcast table; -1 is a rare word (hash in the list beside it), -2 the start mark.
_RARE, _AT_START = -1, -2
_PAIRS = (
    "bucket int, base long, first array<int>, rare_first array<long>, sizes array<int>, next array<int>, rare array<long>, "
    "doc array<short>, times array<int>"
)


def _list_array(ends: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(values, kind))


def _pairs(buckets: int, hot, id_type: pa.DataType):
    """Packed pairs of a block, a row per bucket, and a row with its documents."""

    def block(batch: pa.RecordBatch, base: int) -> Iterator[pa.RecordBatch]:
        ends, words = _lists(batch.column(1))
        sizes = np.diff(ends)
        doc = np.repeat(np.arange(len(sizes)), sizes)
        first = np.empty_like(words)
        first[1:] = words[:-1]
        first[ends[:-1][sizes > 0]] = _START
        place, place_next = hot.value.find(first), hot.value.find(words)
        spread = (place >= 0) | (first == _START)
        bucket = (_mixed(np.where(spread, first * 31 + words, first)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((doc, words, first, bucket))
        bucket, first, words, doc, place, place_next = (x[order] for x in (bucket, first, words, doc, place, place_next))
        new = np.ones(len(words), bool)
        new[1:] = (words[1:] != words[:-1]) | (first[1:] != first[:-1]) | (doc[1:] != doc[:-1])
        at = np.flatnonzero(new)
        times = np.diff(np.append(at, len(new)))
        bucket, first, words, doc, place, place_next = (x[at] for x in (bucket, first, words, doc, place, place_next))
        cut = np.append(np.flatnonzero(np.diff(bucket, prepend=-1)), len(bucket))
        group = np.ones(len(first), bool)
        group[1:] = (first[1:] != first[:-1]) | (bucket[1:] != bucket[:-1])
        starts = np.flatnonzero(group)
        rare = place_next < 0
        group_cut = np.searchsorted(starts, cut)
        first, place = first[starts], np.where(first[starts] == _START, _AT_START, place[starts])
        rare_first = place == _RARE
        rare_first_cut = np.concatenate([[0], np.cumsum(rare_first)])[group_cut]
        rare_cut = np.concatenate([[0], np.cumsum(rare)])[cut]
        n = len(cut) - 1
        none = pa.nulls(n, pa.list_(id_type))
        columns = [
            pa.array(bucket[cut[:-1]], pa.int32()),
            pa.array(np.full(n, base), pa.int64()),
            _list_array(group_cut, place, pa.int32()),
            _list_array(rare_first_cut, first[rare_first], pa.int64()),
            _list_array(group_cut, np.diff(np.append(starts, len(words))), pa.int32()),
            _list_array(cut, place_next, pa.int32()),
            _list_array(rare_cut, words[rare], pa.int64()),
            _list_array(cut, doc, pa.int16()),
            _list_array(cut, times, pa.int32()),
            none,
        ]
        names = ["bucket", "base", "first", "rare_first", "sizes", "next", "rare", "doc", "times", "ids"]
        if n:
            yield pa.RecordBatch.from_arrays(columns, names)
        whole = np.array([0, len(sizes)])
        empty = lambda kind: pa.nulls(1, pa.list_(kind))
        ids = pa.ListArray.from_arrays(pa.array(whole.astype(np.int32)), batch.column(0))
        yield pa.RecordBatch.from_arrays(
            [pa.array([base % buckets], pa.int32()), pa.array([base], pa.int64()), empty(pa.int32()), empty(pa.int64()), _list_array(whole, sizes, pa.int32())]
            + [empty(kind) for kind in (pa.int32(), pa.int64(), pa.int16(), pa.int32())]
            + [ids],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = TaskContext.get().partitionId() << 40
        for batch in batches:
            ends, at = batch.column(1).offsets.to_numpy(), 0
            while at < batch.num_rows:
                fits = int(np.searchsorted(ends, ends[at] + BLOCK_WORDS, "right")) - 1 - at
                part = batch.slice(at, min(max(fits, 1), BLOCK))
                yield from block(part, base)
                base += part.num_rows
                at += part.num_rows

    return run


def _by_bucket(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables of equal ``key`` from rows in its order."""
    parts: list[pa.RecordBatch] = []
    for batch in batches:
        keys = batch.column(key).to_numpy(zero_copy_only=False)
        edges = [0, *(np.flatnonzero(np.diff(keys)) + 1), len(keys)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            if parts and parts[0].column(key)[0].as_py() != keys[start]:
                yield pa.Table.from_batches(parts)
                parts = []
            parts.append(batch.slice(start, end - start))
    if parts:
        yield pa.Table.from_batches(parts)


def _bucket_scores(hot, id_type: pa.DataType):
    names = ["base", "doc", "score", "ids", "sizes", "words", "owner", "times"]

    def values(rows: pa.Table, name: str) -> np.ndarray:
        return rows.column(name).combine_chunks().flatten().to_numpy(zero_copy_only=False)

    def steps(x: np.ndarray) -> np.ndarray:
        return np.rint(np.log2(x) * UNIT).astype(np.int64)

    def scored(rows: pa.Table) -> pa.RecordBatch | None:
        known = hot.value
        place_first = values(rows, "first").astype(np.int64)
        first = np.full(len(place_first), _START, np.int64)
        first[place_first >= 0] = known.words[place_first[place_first >= 0]]
        first[place_first == _RARE] = values(rows, "rare_first")
        first = np.repeat(first, values(rows, "sizes"))
        doc, times, place = values(rows, "doc").astype(np.int64), values(rows, "times").astype(np.int64), values(rows, "next").astype(np.int64)
        lengths = np.diff(rows.column("next").combine_chunks().offsets.to_numpy())
        block = np.repeat(np.arange(len(lengths)), lengths)
        word = np.empty(len(place), np.int64)
        word[place >= 0] = known.words[place[place >= 0]]
        word[place < 0] = values(rows, "rare")
        order = np.lexsort((word, first))
        first, word, doc, times, place, block = (x[order] for x in (first, word, doc, times, place, block))

        def sums(change: np.ndarray) -> np.ndarray:
            at = np.flatnonzero(change)
            return np.repeat(np.add.reduceat(times, at), np.diff(np.append(at, len(change))))

        new_first = np.ones(len(first), bool)
        new_first[1:] = first[1:] != first[:-1]
        new_pair = new_first.copy()
        new_pair[1:] |= word[1:] != word[:-1]
        pair, before = sums(new_pair), sums(new_first)
        at = known.find(first)
        before = np.where(at >= 0, known.n_before[at] if len(known.n_before) else 0, before)
        start = first == _START
        seen = (pair >= MIN_COUNT) & ~start
        rare = ~seen & (place < 0)
        score = np.zeros(len(pair), np.int64)
        score[seen] = steps(pair[seen] / before[seen])
        frequent = ~seen & ~rare
        score[frequent] = steps(known.n[place[frequent]] / known.total)
        score[~seen & ~start] += round(math.log2(BACKOFF) * UNIT)
        # Sums per block and document.
        key = block * BLOCK + doc
        own, back = np.unique(key, return_inverse=True)
        total = np.zeros(len(own), np.int64)
        np.add.at(total, back, score * times)
        bases = rows.column("base").to_numpy()
        cut = np.searchsorted(own, np.arange(len(lengths) + 1) * BLOCK)
        rare_block = block[rare]
        rare_order = np.argsort(rare_block, kind="stable")
        rare_cut = np.searchsorted(rare_block[rare_order], np.arange(len(lengths) + 1))
        take = lambda x: x[rare][rare_order]
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bases),
                _list_array(cut, own % BLOCK, pa.int16()),
                _list_array(cut, total, pa.int64()),
                pa.nulls(len(bases), pa.list_(id_type)),
                pa.nulls(len(bases), pa.list_(pa.int32())),
                _list_array(rare_cut, take(word), pa.int64()),
                _list_array(rare_cut, take(doc), pa.int16()),
                _list_array(rare_cut, take(times), pa.int32()),
            ],
            names,
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, "bucket"):
            owners = rows.filter(rows.column("ids").is_valid())
            if owners.num_rows:
                blank = lambda kind: pa.nulls(owners.num_rows, pa.list_(kind))
                yield pa.RecordBatch.from_arrays(
                    [owners.column("base").combine_chunks(), blank(pa.int16()), blank(pa.int64()), owners.column("ids").combine_chunks()]
                    + [owners.column("sizes").combine_chunks(), blank(pa.int64()), blank(pa.int16()), blank(pa.int32())],
                    names,
                )
            pairs = rows.filter(rows.column("ids").is_null())
            if pairs.num_rows:
                yield scored(pairs)

    return run


def _block_sums(id_type: pa.DataType):
    """Adds up the lists of a block and gives a row per document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _by_bucket(batches, "base"):
            total = np.zeros(BLOCK, np.int64)
            parts = rows.filter(rows.column("doc").is_valid())
            doc, score = (parts.column(n).combine_chunks().flatten().to_numpy(zero_copy_only=False) for n in ("doc", "score"))
            np.add.at(total, doc, score)
            owner = rows.filter(rows.column("ids").is_valid())
            ids, sizes = (owner.column(n).combine_chunks().flatten() for n in ("ids", "sizes"))
            yield pa.RecordBatch.from_arrays([ids.cast(id_type), sizes.cast(pa.int64()), pa.array(total[: len(ids)])], ["doc_id", "n_words", "steps"])

    return run


def scores(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_words, steps`` per row; ``steps / 2**20`` is the score."""
    from pyspark.sql.pandas.types import to_arrow_type

    spark = docs.sparkSession
    ship(spark)
    hashed = _hashed(docs, doc_id, text)
    counts = hashed.select("words").mapInArrow(_word_counts, "word long, n long, n_before long")
    counts = stored(counts.groupBy("word").agg(F.sum("n").alias("n"), F.sum("n_before").alias("n_before")), "word-counts")
    total = counts.agg(F.sum("n")).first()[0] or 0
    hot = spark.sparkContext.broadcast(_Hot(most_frequent(counts, HOT_WORDS).select("word", "n", "n_before").collect(), total))
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), math.ceil(total / BUCKET))
    id_type = docs.schema[doc_id].dataType
    arrow_id, sql_id = to_arrow_type(id_type), id_type.simpleString()
    pairs = hashed.mapInArrow(_pairs(buckets, hot, arrow_id), f"{_PAIRS}, ids array<{sql_id}>")
    found = pairs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(
        _bucket_scores(hot, arrow_id),
        f"base long, doc array<short>, score array<long>, ids array<{sql_id}>, sizes array<int>, words array<long>, owner array<short>, times array<int>",
    )
    found = stored(found, "bucket-scores")
    rare = found.select("base", F.explode(F.arrays_zip("words", "owner", "times")).alias("r")).select("base", "r.*")
    step = F.rint(F.log2(F.col("n") / F.lit(float(max(total, 1)))) * UNIT).cast("long")
    backed = rare.withColumnRenamed("words", "word").join(counts, "word").groupBy("base", "owner").agg(F.sum(step * F.col("times")).alias("score"))
    backed = backed.select("base", F.array("owner").alias("doc"), F.array("score").alias("score"))
    both = found.select("base", "doc", "score", "ids", "sizes").unionByName(backed, allowMissingColumns=True)
    return both.repartition("base").sortWithinPartitions("base").mapInArrow(_block_sums(arrow_id), f"doc_id {sql_id}, n_words long, steps long")


@query("op9_lm_scoring")
def op9_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Score and score per word, in bits."""
    found = scores(table(spark, sf_dir, "documents"))
    score = F.col("steps") / UNIT
    return found.select("doc_id", "n_words", score.alias("log2_score"), F.when(F.col("n_words") > 0, score / F.col("n_words")).alias("per_word"))
