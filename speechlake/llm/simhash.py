"""SimHash near-duplicates, compared bit-sliced.

The fingerprint of a text is the bitwise majority of the XXH64 hashes of its
3-word shingles. Equal fingerprints are one node; nodes within ``RADIUS``
differing bits are linked. With four 16-bit blocks two differing bits leave two
blocks equal, so the six pairs of blocks are keys under which every linked pair
meets. The members of a key are compared in bit planes: a plane holds one bit
of all members, a query adds its differing planes into carry-save counters and
stops as soon as all members are out of reach. A large key is cut into parts,
and each pair of parts is a group of its own, so no task holds a whole key.
Only a spanning forest of a group is emitted.

Defined results: null, empty and blank texts have fingerprint zero and are
linked like any other; repeated rows are separate rows of one class; a null
document id is never a class id unless the class has no other; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from speechlake.llm.common import LOWER, UPPER, query, ship, table
from speechlake.llm.components import components
from speechlake.sources.scratch import stored

RADIUS = 2
SHINGLE = 3
SEED = 42
BLOCKS = 4
# A key of n members is cut into about sqrt(n / PART) parts.
PART = 64
_FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())
_ROWS = 1 << 16


def fingerprint_of(text: str | None) -> int:
    """The unsigned fingerprint of one text."""
    words = (text or "").encode("utf-8", "surrogatepass").translate(_FOLD).split()
    if not words:
        return 0
    if len(words) < SHINGLE:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(SHINGLE))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], np.uint64)
    ones = np.zeros(64, np.int64)
    for at in range(0, len(hashes), _ROWS):
        octets = hashes[at : at + _ROWS].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(octets, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > len(hashes), bitorder="little").tobytes(), "little")


@F.pandas_udf(T.LongType())
def fingerprint(texts: pd.Series) -> pd.Series:
    """Signed 64-bit fingerprints."""
    return pd.Series(np.array([fingerprint_of(t) for t in texts], np.uint64).view(np.int64))


def planes_of(values: np.ndarray) -> list[int]:
    """Bit i of plane j is bit j of value i."""
    bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    packed = np.packbits(bits.T, axis=1, bitorder="little")
    return [int.from_bytes(row.tobytes(), "little") for row in packed]


def within(value: int, planes: list[int], everyone: int, radius: int) -> int:
    """The members (as a bit set) at ``radius`` or fewer bits from a value.

    The counters start so high that bit ``radius + 1`` carries out of the top.
    """
    size = (radius + 1).bit_length()
    start = (1 << size) - 1 - radius
    counters = [everyone if start >> k & 1 else 0 for k in range(size)]
    beyond = 0
    for j, plane in enumerate(planes):
        carry = plane ^ everyone if value >> j & 1 else plane
        for k in range(size):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        beyond |= carry
        if beyond == everyone:
            return 0
    return everyone & ~beyond


def forest(values: np.ndarray, radius: int = RADIUS) -> Iterator[tuple[int, int]]:
    """Links between distinct values that span the group's components."""
    planes, everyone = planes_of(values), (1 << len(values)) - 1
    known = [int(v) for v in values.view(np.uint64)]
    left = everyone
    while left:
        first = left & -left
        left ^= first
        queue = [first.bit_length() - 1]
        while queue and left:
            at = queue.pop()
            near = within(known[at], planes, everyone, radius) & left
            left ^= near
            while near:
                bit = near & -near
                near ^= bit
                queue.append(bit.bit_length() - 1)
                yield at, queue[-1]


def _group_links(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links of each group of rows (g, fp) that arrive in the order of g."""

    def links(values: np.ndarray) -> pa.RecordBatch:
        found = list(forest(values))
        u, v = (np.array([f[k] for f in found], np.int64) for k in (0, 1))
        return pa.RecordBatch.from_arrays([pa.array(values[u]), pa.array(values[v])], ["u", "v"])

    open_group, open_values = None, []
    for batch in batches:
        groups, values = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
        edges = [0, *(np.flatnonzero(np.diff(groups)) + 1), len(groups)]
        for start, end in zip(edges, edges[1:]):
            if start == end:
                continue
            if open_values and groups[start] != open_group:
                yield links(np.unique(np.concatenate(open_values)))
                open_values = []
            open_group = groups[start]
            open_values.append(values[start:end])
    if open_values:
        yield links(np.unique(np.concatenate(open_values)))


def _keys(fp: Column) -> Column:
    """Six keys: each pair of the four blocks, with the pair's number."""
    width = 64 // BLOCKS
    block = [F.shiftrightunsigned(fp, width * i).bitwiseAND(F.lit((1 << width) - 1)) for i in range(BLOCKS)]
    return F.array(
        *(
            F.lit(n << 2 * width).bitwiseOR(F.shiftleft(block[i], width)).bitwiseOR(block[j])
            for n, (i, j) in enumerate(combinations(range(BLOCKS), 2))
        )
    )


def links(prints: DataFrame) -> DataFrame:
    """Links ``(u, v)`` that connect all distinct ``fp`` within the radius."""
    keyed = prints.select("fp", F.explode(_keys(F.col("fp"))).alias("key"))
    sizes = stored(keyed.groupBy("key").count().where("count > 1").select("key", F.col("count").alias("n")), "key-sizes")
    parts = F.ceil(F.sqrt(F.col("n") / PART)).cast("int")
    grouped = (
        keyed.join(sizes, "key")
        .select("fp", "key", parts.alias("parts"))
        .withColumn("part", F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        .select(F.xxhash64("key", F.least("part", "other"), F.greatest("part", "other")).alias("g"), "fp")
    )
    return grouped.repartition("g").sortWithinPartitions("g").mapInArrow(_group_links, "u long, v long")


def _class_rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``doc_id, fp, component_id, root``; the root tells classes of equal ids apart."""
    ship(docs.sparkSession)
    rows = stored(docs.select(F.col(doc_id).alias("doc_id"), fingerprint(F.col(text)).alias("fp")), "fingerprints")
    prints = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first_doc")), "prints")
    roots = stored(components(links(prints)), "roots").withColumnRenamed("node", "fp")
    linked = stored(prints.join(roots, "fp"), "linked")
    smallest = stored(linked.groupBy("root").agg(F.min("first_doc").alias("component_id")), "smallest")
    linked = linked.join(smallest, "root").select("fp", "component_id", "root")
    named = stored(
        prints.join(linked, "fp", "left").select("fp", F.coalesce("component_id", "first_doc").alias("component_id"), F.coalesce("root", "fp").alias("root")), "classes"
    )
    return rows.join(named, "fp").select("doc_id", "fp", "component_id", "root")


def classes(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, fp, component_id`` for every row; the id is the smallest
    document id that links reach."""
    return _class_rows(docs, doc_id, text).drop("root")


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each class: the one whose id names it, of several the
    one with the smallest fingerprint."""
    found = stored(_class_rows(docs, doc_id, text), "class-rows")
    named = F.col("doc_id").eqNullSafe(F.col("component_id"))
    kept = stored(found.where(named).groupBy("root").agg(F.min("fp").alias("_kept")).select("_kept"), "kept")
    found = found.join(kept, F.col("fp") == F.col("_kept"), "left")
    named = named & F.col("_kept").isNotNull()
    gone = found.where(~named).select(F.col("doc_id").alias("_id"), F.col("fp").alias("_gone")).distinct()
    repeated = stored(
        found.where(named).groupBy("doc_id", "fp").count().where("count > 1").select(F.col("doc_id").alias("_id"), F.col("fp").alias("_again")),
        "repeated",
    )
    rows = docs.withColumn("_fp", fingerprint(F.col(text)))
    same = lambda other: (F.col("_fp") == F.col(other)) & F.col(doc_id).eqNullSafe(F.col("_id"))
    rows = rows.join(stored(gone, "gone"), same("_gone"), "left_anti")
    once = rows.join(repeated, same("_again"), "left_anti")
    again = rows.join(repeated, same("_again"), "left_semi").dropDuplicates([doc_id, "_fp"])
    return once.union(again).select(*docs.columns)


@query("op2_simhash_dedup")
def op2_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = classes(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
