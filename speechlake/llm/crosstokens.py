"""Alignment of two tokenizers: which tokens end together, over a whole corpus.

Each text is encoded once by a byte-level BPE file (A) and by a piece model
(B). Byte offsets where tokens of both end cut the text into groups; the two
tokens that end at such an offset are linked, and a pair of ids counts its
links in the corpus.

Most groups are one token on each side, with the same bytes. For them the map
from A's ids to B's ids of the same bytes is computed beforehand, so a task
counts them in a vector as long as A's vocabulary. Only links of other groups
are pairs that are shuffled, summed up in each task before. Documents keep their
distinct links with multiplicities, so nothing is encoded twice: in a second
pass they meet the vector, the highest count of each B id (both bounded by the
vocabularies) and the ``HOT_PAIRS`` most frequent other pairs; rarer pairs meet
their counts in a shuffled join.

Texts are cut before single spaces between two other characters, where no token
of either side reaches across. A task encodes each unit once as long as it
remembers it, and a text is put together from its units.

Defined results: texts that are null, empty, or not given back byte by byte by
both tokenizers have zeros and an empty ``groups_sha256``; special strings in a
text are plain text; of several B ids with the same bytes the map takes the
piece before the byte; repeated rows count each by themselves; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import most_frequent, query, ship, table
from speechlake.sources.scratch import stored

FIRST, SECOND = "byte_bpe_50k.json", "piece_bpe_32k.model"
# Characters of the texts that are worked on at a time.
CUT = 1 << 20
HOT_PAIRS = 65536
# Distinct pairs that a task holds before it passes them on, and units that it
# remembers (of 64 characters each on average).
HELD = 200_000

_PLACE = re.compile(r"(?<=[^\s▁]) (?=[^\s▁])")
_SHIFT = 32


def _letters() -> dict[str, int]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 for itself, the rest from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + n): b for n, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers with the bytes of their tokens."""

    def __init__(self, first: str, second: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import public_tokenizers
        import sentencepiece
        from tokenizers import Tokenizer

        self.a = Tokenizer.from_file(public_tokenizers.path(first))
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(second))
        letters, known = _letters(), self.a.get_vocab(with_added_tokens=False)
        self.a_bytes = [b""] * (max(known.values(), default=-1) + 1)
        for token, at in known.items():
            self.a_bytes[at] = bytes(letters[c] for c in token)
        self.b_bytes = [self._piece(i) for i in range(self.b.get_piece_size())]
        self.a_size, self.b_size = (np.array([len(x) for x in side], np.int64) for side in (self.a_bytes, self.b_bytes))
        same: dict[bytes, int] = {}
        for i, x in enumerate(self.b_bytes):
            if x and (x not in same or self.b.is_byte(same[x])):
                same[x] = i
        self.same = np.array([same.get(x, -1) for x in self.a_bytes], np.int64)
        self.names = [str(i) for i in range(max(len(self.a_bytes), len(self.b_bytes)))]

    def _piece(self, i: int) -> bytes:
        if self.b.is_control(i) or self.b.is_unknown(i):
            return b""
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace("▁", " ").encode()

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of both sides of texts; a space stands before each of them."""
        left = self.a.encode_batch_fast([" " + u for u in units], add_special_tokens=False)
        return [x.ids for x in left], self.b.encode(units, num_threads=1)

    def faithful(self, unit: str, a: list[int], b: list[int]) -> bool:
        """Whether both sides give the text back byte by byte."""
        whole = b" " + unit.encode()
        return b"".join([self.a_bytes[i] for i in a]) == whole == b"".join([self.b_bytes[i] for i in b])


def units_of(text: str | None) -> list[str]:
    """A text cut at single spaces between other characters, which go."""
    return _PLACE.split(text) if text else []


@lru_cache(maxsize=1)
def tokenizers(first: str, second: str) -> Tokenizers:
    return Tokenizers(first, second)


def groups(a: np.ndarray, b: np.ndarray, t: Tokenizers) -> tuple[np.ndarray, np.ndarray]:
    """Places of the tokens of both sides that end groups."""
    ends, others = np.cumsum(t.a_size[a]), np.cumsum(t.b_size[b])
    at = np.minimum(np.searchsorted(others, ends), len(others) - 1)
    last = np.flatnonzero(others[at] == ends)
    return last, at[last]


class Units:
    """Encoded units, by number: what a text needs to know of each."""

    def __init__(self, t: Tokenizers):
        self.t = t
        self.forget()

    def forget(self) -> None:
        self.number: dict[str, int] = {}
        self.letters = 0
        self.spelt: list[str] = []
        # Tokens of A and B, groups, and whether both sides are faithful; per unit.
        self.facts = np.zeros((0, 4), np.int64)
        self.links, self.alone = np.zeros(0, np.int64), np.zeros(0, bool)
        self.first = np.zeros(1, np.int64)

    def add(self, units: list[str]) -> None:
        """Encode units that are not known; all at once, as no group crosses units."""
        t = self.t
        if not units:
            return
        a, b = t.encode(units)
        good = [t.faithful(u, x, y) for u, x, y in zip(units, a, b)]
        a, b = ([x if g else [] for x, g in zip(side, good)] for side in (a, b))
        left, right = (np.fromiter((i for x in side for i in x), np.int64) for side in (a, b))
        x, y = groups(left, right, t) if len(left) else (np.zeros(0, np.int64),) * 2
        n_a, n_b = (np.array([len(x) for x in side], np.int64) for side in (a, b))
        n = np.diff(np.searchsorted(x, np.cumsum(n_a)), prepend=0)
        alone = (np.diff(x, prepend=-1) == 1) & (np.diff(y, prepend=-1) == 1) & (t.same[left[x]] == right[y])
        self.facts = np.concatenate([self.facts, np.stack([n_a, n_b, n, np.array(good, np.int64)], axis=1)])
        self.first = np.concatenate([self.first, self.first[-1] + np.cumsum(n)])
        self.links = np.concatenate([self.links, left[x] << _SHIFT | right[y]])
        self.alone = np.concatenate([self.alone, alone])
        names, at, s, u = t.names, 0, 0, 0
        left, right, x, y = (v.tolist() for v in (left, right, x + 1, y + 1))
        for unit, many in zip(units, n.tolist()):
            out = []
            for e, f in zip(x[at : at + many], y[at : at + many]):
                out.append(f"{','.join([names[i] for i in left[s:e]])}|{','.join([names[i] for i in right[u:f]])}")
                s, u = e, f
            at += many
            self.number[unit] = len(self.spelt)
            self.spelt.append(";".join(out))
            self.letters += len(unit)


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *(len(p) for p in parts)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *parts]), pa.int64()))


_LISTS = ["same", "same_n", "odd", "odd_n"]
_NUMBERS = ["n_a", "n_b", "n_groups"]


def _slices(texts: pa.Array) -> Iterator[list[list[str]]]:
    """Units of neighbouring texts of together about ``CUT`` characters."""
    held, size = [], 0
    for value in texts:
        text = value.as_py()
        held.append(units_of(text))
        size += len(text or "")
        if size > CUT:
            yield held
            held, size = [], 0
    if held:
        yield held


def _encoded(first: str, second: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        t = tokenizers(first, second)
        known, vector, odd, kind = Units(t), np.zeros(len(t.a_bytes), np.int64), Counter(), None

        def made(ids: pa.Array, numbers: np.ndarray, shas: list[str], lists: list[pa.Array], total: bool) -> pa.RecordBatch:
            columns = [ids, *(pa.array(numbers[:, k]) for k in range(3)), pa.array(shas, pa.string()), *lists]
            return pa.RecordBatch.from_arrays([*columns, pa.array([total] * len(ids), pa.bool_())], ["doc_id", *_NUMBERS, "groups_sha256", *_LISTS, "total"])

        def totals() -> pa.RecordBatch:
            """What the task has counted; one row."""
            seen = np.flatnonzero(vector)
            pairs = (np.fromiter(x, np.int64, len(odd)) for x in (odd.keys(), odd.values()))
            out = made(pa.nulls(1, kind), np.zeros((1, 3), np.int64), [""], [_lists([x]) for x in (seen, vector[seen], *pairs)], True)
            vector[:] = 0
            odd.clear()
            return out

        for batch in batches:
            kind, start = batch.column(0).type, 0
            for texts in _slices(batch.column(1)):
                if len(known.number) > HELD or known.letters > 64 * HELD:
                    known.forget()
                known.add([u for u in dict.fromkeys(u for units in texts for u in units) if u not in known.number])
                sizes = np.array([len(units) for units in texts], np.int64)
                numbers = [known.number[u] for units in texts for u in units]
                at, doc = np.array(numbers, np.int64), np.repeat(np.arange(len(texts)), sizes)
                good = np.bincount(doc, 1 - known.facts[at, 3], len(texts)) == 0
                good &= sizes > 0
                facts = np.stack([np.bincount(doc, known.facts[at, k], len(texts)) for k in range(3)], axis=1).astype(np.int64) * good[:, None]
                shas, place = [], 0
                for size, fine in zip(sizes.tolist(), good.tolist()):
                    spelt = ";".join([known.spelt[k] for k in numbers[place : place + size]]) if fine else ""
                    shas.append(hashlib.sha256(spelt.encode()).hexdigest() if fine else "")
                    place += size
                # Distinct units per text, then their links, then distinct links per text.
                key, many = np.unique((doc * len(known.spelt) + at)[good[doc]], return_counts=True)
                doc, at = np.divmod(key, max(len(known.spelt), 1))
                n = known.first[at + 1] - known.first[at]
                link = np.repeat(known.first[at] - np.cumsum(n) + n, n) + np.arange(n.sum())
                pairs, name = np.unique(known.links[link], return_inverse=True)
                alone = np.zeros(len(pairs), bool)
                alone[name] = known.alone[link]
                key, where = np.unique(np.repeat(doc, n) * len(pairs) + name, return_inverse=True)
                sums = np.bincount(where, np.repeat(many, n), len(key)).astype(np.int64)
                doc, name = np.divmod(key, max(len(pairs), 1))
                own = alone[name]
                same, other = pairs[name[own]] >> _SHIFT, pairs[name[~own]]
                vector += np.bincount(same, sums[own], len(vector)).astype(np.int64)
                total = np.bincount(name[~own], sums[~own], len(pairs)).astype(np.int64)
                for k in np.flatnonzero(total).tolist():
                    odd[int(pairs[k])] += int(total[k])
                lists = []
                for which, values in ((own, same), (own, sums[own]), (~own, other), (~own, sums[~own])):
                    ends = np.searchsorted(doc[which], np.arange(len(texts) + 1))
                    lists.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values, pa.int64())))
                yield made(batch.column(0).slice(start, len(texts)), facts, shas, lists, False)
                start += len(texts)
                if len(odd) > HELD:
                    yield totals()
        if kind is not None:
            yield totals()

    return run


def _weighed(known):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, best, same, hot, hot_n = known.value
        if not len(hot):
            hot, hot_n = np.full(1, -1, np.int64), np.zeros(1, np.int64)
        for batch in batches:
            columns = [batch.column(n) for n in _LISTS]
            sets = [(c.offsets.to_numpy() - c.offsets[0].as_py(), c.flatten().to_numpy(zero_copy_only=False)) for c in columns]
            n_best, sums, rare, rare_n = [], [], [], []
            for k in range(batch.num_rows):
                ids, n, pairs, m = (values[ends[k] : ends[k + 1]] for ends, values in sets)
                own = counts[ids]
                at = np.minimum(np.searchsorted(hot, pairs), len(hot) - 1)
                met = hot[at] == pairs
                other, k_n = hot_n[at[met]], m[met]
                n_best.append(int(n[own == best[same[ids]]].sum() + k_n[other == best[pairs[met] & 0xFFFFFFFF]].sum()))
                sums.append(int((own * n).sum() + (other * k_n).sum()))
                rare.append(pairs[~met])
                rare_n.append(m[~met])
            kept = [batch.column(n) for n in ("row", "doc_id", *_NUMBERS, "groups_sha256")]
            added = [pa.array(n_best, pa.int64()), pa.array(sums, pa.int64()), _lists(rare), _lists(rare_n)]
            yield pa.RecordBatch.from_arrays(
                [*kept, *added], ["row", "doc_id", *_NUMBERS, "groups_sha256", "n_best", "count_sum", "rare", "rare_n"]
            )

    return run


def encoded(docs: DataFrame, first: str = FIRST, second: str = SECOND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row its sizes, digest and distinct links (``same``: A ids of groups
    whose B id the map knows, ``odd``: other pairs, A id above B id), and rows
    with the sums of a task (``total``)."""
    ship(docs.sparkSession)
    id_type = docs.schema[doc_id].dataType.simpleString()
    lists = ", ".join(f"{n} array<long>" for n in _LISTS)
    schema = f"doc_id {id_type}, n_a long, n_b long, n_groups long, groups_sha256 string, {lists}, total boolean"
    rows = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")).mapInArrow(_encoded(first, second), schema)
    # Written once, so a row keeps its number whatever is computed again.
    return stored(rows.withColumn("row", F.monotonically_increasing_id()), "encoded")


def pair_counts(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``a, n`` of the links that the map knows, ``pair, n`` of the others."""

    def summed(key: str, n: str, name: str) -> DataFrame:
        entry = F.explode_outer(F.arrays_zip(key, n)).alias("e")
        flat = rows.where("total").select(entry).where("e IS NOT NULL").select(F.col(f"e.{key}").alias(name), F.col(f"e.{n}").alias("n"))
        return flat.groupBy(name).agg(F.sum("n").alias("n"))

    return summed("same", "same_n", "a"), summed("odd", "odd_n", "pair")


def aligned(docs: DataFrame, first: str = FIRST, second: str = SECOND, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row ``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum,
    groups_sha256``."""
    spark = docs.sparkSession
    rows = encoded(docs, first, second, doc_id, text)
    same, odd = pair_counts(rows)
    odd = stored(odd, "pairs")
    t = tokenizers(first, second)
    counts, best = np.zeros(len(t.a_bytes), np.int64), np.zeros(len(t.b_bytes), np.int64)
    for a, n in same.collect():  # at most a row per A id
        counts[a], best[t.same[a]] = n, n
    b = F.col("pair").bitwiseAND(0xFFFFFFFF).alias("b")
    for i, n in odd.groupBy(b).agg(F.max("n")).collect():  # at most a row per B id
        best[i] = max(best[i], n)
    hot = np.array(sorted((p, n) for p, n in most_frequent(odd, HOT_PAIRS).select("pair", "n").collect()), np.int64).reshape(-1, 2)
    known = spark.sparkContext.broadcast((counts, best, t.same, hot[:, 0].copy(), hot[:, 1].copy()))
    id_type = docs.schema[doc_id].dataType.simpleString()
    numbers = ", ".join(f"{n} long" for n in _NUMBERS)
    found = stored(
        rows.where("NOT total").drop("total").mapInArrow(
            _weighed(known), f"row long, doc_id {id_type}, {numbers}, groups_sha256 string, n_best long, count_sum long, rare array<long>, rare_n array<long>"
        ),
        "weighed",
    )
    known.destroy()
    rare = found.select("row", F.explode_outer(F.arrays_zip("rare", "rare_n")).alias("r")).where("r IS NOT NULL")
    rare = rare.select("row", F.col("r.rare").alias("pair"), F.col("r.rare_n").alias("k"))
    highest = spark.createDataFrame([(i, int(n)) for i, n in enumerate(best)], "b long, best long")
    judged = odd.withColumn("b", b).join(F.broadcast(highest), "b").select("pair", "n", (F.col("n") == F.col("best")).alias("top"))
    parts = rare.join(judged, "pair").select(
        "row", F.when(F.col("top"), F.col("k")).otherwise(0).alias("n_best"), (F.col("k") * F.col("n")).alias("count_sum")
    )
    kept = ["doc_id", *_NUMBERS, "groups_sha256"]
    return (
        found.drop("rare", "rare_n")
        .unionByName(parts, allowMissingColumns=True)
        .groupBy("row")
        .agg(*(F.max(c).alias(c) for c in kept), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
        .select("doc_id", "n_a", "n_b", "n_groups", F.col("n_groups").alias("n_links"), "n_best", "count_sum", "groups_sha256")
    )


@query("op11_cross_tokenizer_alignment")
def op11_cross_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return aligned(table(spark, sf_dir, "documents"))
