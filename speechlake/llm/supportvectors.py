"""Quality classifier: support vectors over naive Bayes features.

A text's features are indicators of its n-grams: words and word pairs, and one
to three neighbouring word shapes. A shape keeps the classes of a word's
characters without repeats (``Ab,`` or ``A!``), and a word that repeats the one
before it has a shape of its own. N-grams are hashed into ``1 << BITS`` slots.

Learning joins the labels to the documents (of fixed size, a bitmap of the
labels' ids spares most other texts the shuffle), counts each slot's documents per
class over all labelled rows, and takes the log ratio of the two smoothed
shares. Indicators are scaled by these ratios, rows to length 1, and a linear
hinge-loss model is fitted by dual coordinate descent, in one task over a sample
of at most ``2 * FIT_ROWS`` rows by hash of the id (about ``FIT_ROWS``; the bound
is a parameter). A fifth of the labelled rows has no part in that; its margins
(as many rows at most) give the sigmoid that turns a margin into a score. Ratios
and weights become one vector of ``1 << BITS`` numbers, which is broadcast.

Only rows outside the held-out fifth (crc32 of the id) are learnt from, and only
the text is looked at.

Defined results: null and empty texts have no features and the score of the
bias; an id whose labels differ, or are null, is not learnt from; a null id is
held out; without rows of both classes the score is the smoothed share of label
1 (one half without any); a single class in the sigmoid's rows gives way to the
fitted ones; repeated rows count each by themselves; an empty table gives no
rows. Texts of any length are taken in stretches of ``STRETCH`` words.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import query, ship, table
from speechlake.sources.scratch import stored

BITS = 18
FIT_ROWS = 10_000
COST, EPOCHS = 1.0, 12
THRESHOLD = 0.3
FOLDS = 5
# Bits of the labels' ids: 4 MB.
ID_BITS = 1 << 25
# Words of a text that are worked on at a time, and words that a task remembers.
STRETCH, HELD = 1 << 18, 300_000

_CLASS = bytes(
    ord("A") if 65 <= b <= 90 else ord("a") if 97 <= b <= 122 or b >= 128 else ord("0") if 48 <= b <= 57 else b for b in range(256)
)
_RUN = re.compile(rb"(.)\1+", re.S)
_REPEAT = np.uint64(7)


class Words(dict):
    """Hashes of words and of their shapes."""

    def __missing__(self, word: bytes) -> tuple[int, int]:
        if len(self) > HELD:
            self.clear()
        shape = _RUN.sub(rb"\1", word.translate(_CLASS))
        found = self[word] = (zlib.crc32(word) | 1 << 32, zlib.crc32(shape) | 1 << 33)
        return found


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return (x ^ (x >> np.uint64(33))) >> np.uint64(64 - BITS)


def features(text: str | None, known: Words) -> np.ndarray:
    """Slots of a text's n-grams, each once, rising."""
    words = text.encode("utf-8", "surrogatepass").split() if text else []
    found = []
    for start in range(0, len(words), STRETCH):
        low = max(start - 3, 0)  # n-grams across the border, and the word before them
        hashes = np.array([known[w] for w in words[low : start + STRETCH]], np.uint64)
        word, shape = hashes[:, 0], hashes[:, 1].copy()
        shape[1:][word[1:] == word[:-1]] = _REPEAT
        if low:
            word, shape = word[1:], shape[1:]
        pairs = shape[:-1] * np.uint64(0x100000001B3) + shape[1:]
        triples = pairs[:-1] * np.uint64(0x100000001B3) + shape[2:]
        both = word[:-1] * np.uint64(0x9E3779B97F4A7C15) + word[1:]
        grams = [shape, pairs + np.uint64(1), triples + np.uint64(2), word, both]
        found.append(np.unique(_mixed(np.concatenate(grams))))
    if len(found) > 1:
        return np.unique(np.concatenate(found)).astype(np.int32)
    return (found[0] if found else np.zeros(0)).astype(np.int32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    known = Words()
    for batch in batches:
        steps = [np.diff(features(t.as_py(), known), prepend=0) for t in batch.column("text")]
        ends = np.cumsum([0, *map(len, steps)])
        lists = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *steps]), pa.int32()))
        yield pa.RecordBatch.from_arrays([batch.column("good"), batch.column("fold"), batch.column("mark"), lists], ["good", "fold", "mark", "steps"])


def _rows(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """Slots of every row."""
    lists = batch.column("steps")
    ends, values = lists.offsets.to_numpy(), lists.values.to_numpy()
    return (np.cumsum(values[a:b]) for a, b in zip(ends, ends[1:]))


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents per slot and class; the last slot counts all documents."""
    counts = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        for good, slots in zip(batch.column("good").to_pylist(), _rows(batch)):
            counts[good, slots] += 1
            counts[good, -1] += 1
    seen = np.flatnonzero(counts.any(axis=0))
    yield pa.RecordBatch.from_arrays([pa.array(seen.astype(np.int32)), *(pa.array(c[seen]) for c in counts)], ["slot", "bad", "good"])


def fold(doc_id: str = "doc_id"):
    """Remainder of the id's crc32; a null id counts as an empty one."""
    return (F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % FOLDS).cast("int")


def _id_bit(column: str) -> Column:
    return F.pmod(F.xxhash64(column), F.lit(ID_BITS))


def likely_labelled(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows whose ``_id`` has a label, and few others: a task tells by a
    broadcast bitmap of ``ID_BITS`` hashes, so most texts without one stay."""
    if rows.schema["_id"].dataType != labels.schema["doc_id"].dataType:
        return rows  # equal ids of two types have unequal hashes
    bit = labels.select(_id_bit("doc_id").alias("bit"))
    bits = bit.groupBy(F.bitmap_bucket_number("bit").alias("_bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("_bits"))
    at = F.bitmap_bit_position(_id_bit("_id")).cast("int")
    byte = F.conv(F.hex(F.substring("_bits", F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    on = F.floor(byte / F.pow(F.lit(2), at % 8)) % 2 == 1
    return rows.join(F.broadcast(bits), (F.bitmap_bucket_number(_id_bit("_id")) == F.col("_bucket")) & on, "left_semi")


def labelled(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``good, fold, mark, steps`` of the rows to learn from; ``mark`` is a hash
    of the id, ``steps`` lead from slot to slot, as small numbers are stored best."""
    agreed = labels.groupBy(F.col("doc_id").alias("_id")).agg(F.min("quality").alias("_least"), F.max("quality").alias("_good"))
    agreed = agreed.where("_least = _good AND _good IN (0, 1)").select("_id", F.col("_good").cast("int").alias("good"))
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("text"), fold(doc_id).alias("fold")).where("fold <> 0")
    joined = likely_labelled(rows, labels).join(agreed, "_id").select("text", "good", "fold", F.xxhash64("_id").alias("mark"))
    return stored(joined.mapInArrow(_featured, "good int, fold int, mark long, steps array<int>"), "labelled")


def log_ratios(rows: DataFrame) -> tuple[np.ndarray, int, int]:
    """Per slot the log ratio of the classes' smoothed shares; rows per class."""
    counts = rows.mapInArrow(_counted, "slot int, bad long, good long").groupBy("slot").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
    found = counts.toArrow()  # a row per slot
    bad, good = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)
    at = found["slot"].to_numpy()
    bad[at], good[at] = found["bad"].to_numpy(), found["good"].to_numpy()
    ratio = np.log((good[:-1] + 1) / (good[-1] + 2)) - np.log((bad[:-1] + 1) / (bad[-1] + 2))
    return ratio, int(good[-1]), int(bad[-1])


def descent(slots: list[np.ndarray], signs: np.ndarray, ratio: np.ndarray, cost: float = COST, epochs: int = EPOCHS) -> tuple[np.ndarray, float]:
    """Weights and bias of the least ``|w|^2 / 2 + cost * hinge loss``."""
    values = [scaled(ratio, s) for s in slots]
    square = np.array([v @ v + 1 for v in values])
    weights, bias, dual = np.zeros(len(ratio)), 0.0, np.zeros(len(slots))
    draw = np.random.default_rng(7)
    for _ in range(epochs):
        for i in draw.permutation(len(slots)):
            at, x = slots[i], values[i]
            slope = signs[i] * (weights[at] @ x + bias) - 1
            new = min(max(dual[i] - slope / square[i], 0.0), cost)
            if new != dual[i]:
                step = (new - dual[i]) * signs[i]
                dual[i] = new
                weights[at] += step * x
                bias += step
    return weights, bias


def scaled(ratio: np.ndarray, slots: np.ndarray) -> np.ndarray:
    """A row's indicators times their ratios, as a vector of length 1."""
    x = ratio[slots]
    size = np.sqrt(x @ x)
    return x / size if size > 0 else x


def sigmoid_of(margins: np.ndarray, good: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the likeliest sigmoid, with smoothed targets (Platt, 1999)."""
    n, m = good.sum(), (~good).sum()
    target = np.where(good, (n + 1) / (n + 2), 1 / (m + 2))
    x = np.stack([margins, np.ones(len(margins))], axis=1)
    at = np.array([1.0, np.log((n + 1) / (m + 1))])

    def loss(at: np.ndarray) -> float:
        z = x @ at
        return float((np.logaddexp(0, z) - target * z).sum())

    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -500, 500)))
        slope, bend = x.T @ (p - target), (x * (p * (1 - p))[:, None]).T @ x + 1e-9 * np.eye(2)
        step, size, now = np.linalg.solve(bend, slope), 1.0, loss(at)
        while size > 1e-10 and loss(at - size * step) > now:
            size /= 2
        at = at - size * step
        if np.abs(slope).max() < 1e-8 * len(margins):
            break
    return float(at[0]), float(at[1])


def _fitted(known, most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = known.value
        parts: dict[bool, list] = {True: [], False: []}
        for batch in batches:
            for good, own, slots in zip(batch.column("good").to_pylist(), batch.column("fold").to_pylist(), _rows(batch)):
                if len(parts[own > 1]) < most:
                    parts[own > 1].append((good, slots))
        slots = [s for _, s in parts[True]]
        good = np.array([g for g, _ in parts[True]], bool)
        weights, bias = descent(slots, np.where(good, 1.0, -1.0), ratio)
        aside = parts[False] if len({g for g, _ in parts[False]}) == 2 else parts[True]
        margins = np.array([weights[s] @ scaled(ratio, s) + bias for _, s in aside])
        slope, offset = sigmoid_of(margins, np.array([g for g, _ in aside], bool))
        columns = [pa.array([weights.tobytes()], pa.binary()), *(pa.array([x], pa.float64()) for x in (bias, slope, offset))]
        yield pa.RecordBatch.from_arrays(columns, ["weights", "bias", "slope", "offset"])

    return run


def learn(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> tuple[np.ndarray, np.ndarray, float, float, float]:
    """``ratio, weights, bias, slope, offset``."""
    spark = docs.sparkSession
    ship(spark)
    rows = labelled(docs, labels, doc_id, text)
    ratio, n_good, n_bad = log_ratios(rows.where("fold > 1"))
    nothing = np.zeros(1 << BITS)
    if not n_good or not n_bad:
        return ratio, nothing, 0.0, 0.0, float(np.log((n_good + 1) / (n_bad + 1)))
    share = min(fit_rows / (n_good + n_bad), 1.0)
    near = F.pmod("mark", F.lit(1 << 30)) < int(share * (1 << 30))
    sample = rows.where(near).limit(3 * fit_rows).repartition(1)
    known = spark.sparkContext.broadcast(ratio)
    weights, bias, slope, offset = sample.mapInArrow(_fitted(known, 2 * fit_rows), "weights binary, bias double, slope double, offset double").first()
    known.destroy()
    return ratio, np.frombuffer(bytes(weights)), bias, slope, offset


def _scored(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio, weights, bias, slope, offset = model.value
        known = Words()
        for batch in batches:
            scores = []
            for text in batch.column(1):
                slots = features(text.as_py(), known)
                margin = weights[slots] @ scaled(ratio, slots) + bias
                scores.append(1 / (1 + np.exp(-np.clip(slope * margin + offset, -500, 500))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64()), batch.column(2)], ["doc_id", "score", "held_out"])

    return run


def score(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, held_out, score``: how likely label 1 is."""
    spark = docs.sparkSession
    model = spark.sparkContext.broadcast(learn(docs, labels, fit_rows, doc_id, text))
    id_type = docs.schema[doc_id].dataType.simpleString()
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"), (fold(doc_id) == 0).alias("held_out"))
    found = stored(rows.mapInArrow(_scored(model), f"doc_id {id_type}, score double, held_out boolean"), "scores")
    model.destroy()
    return found


@query("op12_quality_classifier")
def op12_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return found.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
