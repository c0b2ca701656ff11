"""SentencePiece encoding and decoding by a relational lattice.

No piece spans a change between blanks-and-letters, digits and other
characters, so a text falls into units that are encoded by themselves. Over the
most frequent short units of the corpus (a bounded number): substrings up to the
longest piece are exploded and equi-joined to the piece table, which gives the
edges of a lattice; the edges are grouped by unit, and an aggregate folds
Viterbi over them (largest sum of piece scores; of equal sums the earliest start
of the last piece, which is the longest piece, wins). A character without a
piece is its UTF-8 bytes.

Documents take these units' ids from a broadcast table of fixed size. All other
units go through the same lattice where they stand, many at a time: a pair of a
document and a rare unit costs more to shuffle to its ids and back than to
encode, and the documents need not move at all.

The scores of the file are used as they are. The file's own library merges
pairs by rank instead, so its ids differ where the best path is not the one
that merging finds; decoding agrees.

Defined results: null and empty texts have no pieces and decode to the empty
text; a text's own U+2581 decodes to a blank, as in the library; repeated rows
get equal results; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import functools
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.functions.let import let
from speechlake.llm.common import query, ship, table
from speechlake.llm.tokencounts import HOT_LENGTH, PLAIN, frequent
from speechlake.sources.scratch import stored

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
HOT_UNITS = 65536
# Distinct units that a task holds before it passes them on, or forgets them.
HELD = 100_000
# Characters of units whose lattices a task holds, and of one unit at a time.
CELLS, WINDOW = 1 << 15, 1 << 12
# Documents whose ids a task holds at once.
ROWS = 256
# Characters of a unit whose substrings one row carries.
SEGMENT = 256


def processor(model: str):
    import public_tokenizers
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(model))


def piece_list(model: str) -> list[tuple[str, int, float]]:
    """``piece, id, score`` without bytes and control pieces."""
    sp = processor(model)
    skip = lambda i: sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)
    return [(sp.id_to_piece(i), i, float(sp.get_score(i))) for i in range(sp.get_piece_size()) if not skip(i)]


def unit_cutter(model: str) -> Callable[[str | None], list[str]]:
    """A function that gives a text's units, in order."""
    import regex

    rule = r"▁*[\p{L}\p{M}]+|▁*[^▁\p{L}\p{M}\p{Nd}]+|▁+|\p{Nd}"
    any_text = regex.compile(rule)
    if odd := [p for p, _, _ in piece_list(model) if not any_text.fullmatch(p)]:
        raise ValueError(f"pieces that span units: {odd[:5]}")
    letters = "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] in "LM")
    plain = re.compile(f"▁*[{letters}]+|▁*[^▁{letters}0-9]+|▁+|[0-9]")
    beyond = re.compile(f"[^\x00-{chr(PLAIN - 1)}]")

    def cut(text: str | None) -> list[str]:
        if not text:
            return []
        pattern = any_text if beyond.search(text) else plain
        return pattern.findall(BLANK + text.replace(" ", BLANK))

    return cut


def _distinct_units(model: str):
    """Short units and how often they occur."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, seen = unit_cutter(model), Counter()

        def passed_on() -> pa.RecordBatch:
            short = {unit: n for unit, n in seen.items() if len(unit) <= HOT_LENGTH}
            out = pa.RecordBatch.from_arrays([pa.array(list(short), pa.string()), pa.array(list(short.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py()))
                if len(seen) > HELD:
                    yield passed_on()
        yield passed_on()

    return run


def substrings_of(units: DataFrame, longest: int) -> DataFrame:
    """``uid, unit, n, start, end, piece``: all substrings of up to ``longest``
    characters, with ``unit`` and ``n`` on the first of a unit only."""
    unit, part, at = F.col("unit"), F.col("s.part"), F.col("at")
    segments = F.transform(
        F.sequence(F.lit(0), F.floor((F.length(unit) - 1) / SEGMENT).cast("int")),
        lambda s: F.struct((s * SEGMENT).alias("first"), F.substring(unit, s * SEGMENT + 1, F.lit(SEGMENT + longest - 1)).alias("part")),
    )
    opening = (F.col("s.first") == 0) & (at == 0)
    # Two plain explodes stay in generated code; nested lambdas would not.
    starts = (
        units.repartition("uid")
        .select("uid", "unit", "n", F.explode(segments).alias("s"))
        .select("uid", F.when(F.col("s.first") == 0, unit).alias("unit"), "n", "s", F.explode(F.sequence(F.lit(0), F.least(F.lit(SEGMENT), F.length(part)) - 1)).alias("at"))
        .select("uid", F.when(opening, unit).alias("unit"), F.when(opening, F.col("n")).alias("n"), F.col("s.first").alias("first"), part.alias("part"), "at")
    )
    part, start = F.col("part"), F.col("first") + at
    sizes = F.sequence(F.lit(1), F.least(F.lit(longest), F.length(part) - at))
    cuts = starts.select("uid", "unit", "n", start.alias("start"), "at", "part", F.explode(sizes).alias("size"))
    head = F.col("size") == 1
    return cuts.select(
        "uid",
        F.when(head, unit).alias("unit"),
        F.when(head, F.col("n")).alias("n"),
        "start",
        (F.col("start") + F.col("size")).alias("end"),
        F.substring(part, at + 1, F.col("size")).alias("piece"),
    )


def lattice(units: DataFrame, pieces: DataFrame, longest: int, least: float) -> DataFrame:
    """The edges ``uid, unit, n, start, end, id, score``. An edge without a
    piece is one character; its id is minus its end, so minus its place from 1,
    and its score ``least``."""
    theirs = pieces.select(F.xxhash64("piece").alias("_hash"), F.col("piece").alias("_piece"), "id", "score")
    same = (F.xxhash64("piece") == F.col("_hash")) & (F.col("piece") == F.col("_piece"))
    # The piece table is the model file's vocabulary, so its size is fixed.
    edges = substrings_of(units, longest).join(F.broadcast(theirs), same, "left").where("id IS NOT NULL OR end = start + 1")
    return edges.select("uid", "unit", "n", "start", "end", F.coalesce("id", -F.col("end")).alias("id"), F.coalesce("score", F.lit(least)).alias("score"))


def best_path(edges: Column) -> Column:
    """Ids along the best path; ``edges`` are ``end, start, id, score``.

    In the order of their ends, the edges of one end choose the best way there
    (sum, start, id), which joins the list when the end changes.
    """
    way = "struct<sum:double,start:int,id:int>"
    of = lambda s: F.struct(s["sum"].alias("sum"), s["start"].alias("start"), s["id"].alias("id"))

    def step(state: Column, e: Column) -> Column:
        # Entry k of ``done`` is the best way to position k; the last is still in the state.
        same = e["end"] == state["end"]
        before = F.when(e["start"] == state["end"], state["sum"]).otherwise(F.get(state["done"], e["start"])["sum"])
        better = ~same | (before + e["score"] > state["sum"])
        return F.struct(
            F.when(same, state["done"]).otherwise(F.array_append(state["done"], of(state))).alias("done"),
            e["end"].alias("end"),
            F.when(better, before + e["score"]).otherwise(state["sum"]).alias("sum"),
            F.when(better, e["start"]).otherwise(state["start"]).alias("start"),
            F.when(better, e["id"]).otherwise(state["id"]).alias("id"),
        )

    start = F.struct(
        F.array().cast(f"array<{way}>").alias("done"), F.lit(0).alias("end"), F.lit(0.0).alias("sum"), F.lit(-1).alias("start"), F.lit(0).alias("id")
    )
    ways = F.aggregate(F.sort_array(edges), start, step, lambda s: F.array_append(s["done"], of(s)))

    def back(state: Column, way: Column) -> Column:
        # The ways are met from the last to the first; those on the path count.
        on = state["at"] == state["left"]
        ids = F.when(on, F.array_append(state["ids"], way["id"])).otherwise(state["ids"])
        return F.struct((state["at"] - 1).alias("at"), F.when(on, way["start"]).otherwise(state["left"]).alias("left"), ids.alias("ids"))

    def walk(ways: Column) -> Column:
        last = F.size(ways) - 1
        begin = F.struct(last.alias("at"), last.alias("left"), F.array().cast("array<int>").alias("ids"))
        return F.aggregate(F.reverse(F.slice(ways, 2, last)), begin, back, lambda s: F.reverse(s["ids"]))

    return let(ways, walk)


def _with_bytes(ids: Column, unit: Column, first_byte: int) -> Column:
    """Negative ids (places in the unit) as the ids of the character's UTF-8 bytes."""

    def of(i: Column) -> Column:
        code = F.hex(F.encode(F.substring(unit, -i, F.lit(1)), "UTF-8"))
        byte = lambda k: F.conv(F.substring(code, 2 * k + 1, F.lit(2)), 16, 10).cast("int") + first_byte
        return F.when(i >= 0, F.array(i)).otherwise(F.transform(F.sequence(F.lit(0), (F.length(code) / 2).cast("int") - 1), byte))

    return F.when(F.exists(ids, lambda i: i < 0), F.flatten(F.transform(ids, of))).otherwise(ids)


@functools.lru_cache(4)
def _first_byte(model: str) -> int:
    """The id of the byte 0."""
    return processor(model).piece_to_id("<0x00>")


def count_units(docs: DataFrame, model: str = MODEL, text: str = "text") -> DataFrame:
    """``piece, n``: every distinct unit of at most ``HOT_LENGTH`` characters and how often it occurs."""
    found = docs.select(F.col(text).cast("string")).mapInArrow(_distinct_units(model), "piece string, n long")
    return found.groupBy("piece").agg(F.sum("n").alias("n"))


@functools.lru_cache(4)
def _least(model: str) -> float:
    """Score of a character without a piece: it costs more than any piece (but
    for those the file rules out)."""
    return min(score for _, _, score in piece_list(model) if score > -1e8) - 10


def encode_units(counted: DataFrame, model: str = MODEL) -> DataFrame:
    """``piece, n, ids``: the units with their ids."""
    spark = counted.sparkSession
    known = piece_list(model)
    pieces = spark.createDataFrame(known, "piece string, id int, score double")
    units = stored(counted.select(F.monotonically_increasing_id().alias("uid"), F.col("piece").alias("unit"), "n"), "units")
    edges = lattice(units, pieces, max(len(p) for p, _, _ in known), _least(model))
    grouped = edges.groupBy("uid").agg(
        F.collect_list(F.struct("end", "start", "id", "score")).alias("edges"), F.max("unit").alias("piece"), F.max("n").alias("n")
    )
    ids = _with_bytes(best_path(F.col("edges")), F.col("piece"), _first_byte(model))
    return grouped.select("piece", "n", ids.alias("ids"))


@functools.lru_cache(4)
def _prefixes(model: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """The pieces by their prefixes: steps (prefix and next character plus 1, in
    order), the prefix each leads to, every prefix's id (-1 without a piece) and
    score; and the length of the longest piece."""
    known = piece_list(model)
    steps: dict[int, int] = {}
    ids, scores = [-1], [0.0]
    for piece, number, score in known:
        prefix = 0
        for c in piece:
            key = prefix << 21 | ord(c) + 1
            if key not in steps:
                steps[key] = len(ids)
                ids.append(-1)
                scores.append(0.0)
            prefix = steps[key]
        ids[prefix], scores[prefix] = number, score
    keys = np.array(sorted(steps), np.int64)
    return keys, np.array([steps[k] for k in keys.tolist()]), np.array(ids, np.int32), np.array(scores), max(len(p) for p, _, _ in known)


def _edges(chars: np.ndarray, low: int, high: int, model: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Scores and ids of the edges that end behind the characters ``low`` to
    ``high``, by end, unit and start (the longest piece first)."""
    keys, leads, ids, scores, longest = _prefixes(model)
    first = max(low - longest + 1, 0)
    block = chars[:, first:high]
    gain = np.full((high - low, len(chars), longest), -np.inf)
    kind = np.full(gain.shape, -1, np.int32)
    gain[:, :, -1] = least
    unit, at = np.nonzero(block)
    prefix = np.zeros(len(unit), np.int64)
    for size in range(1, longest + 1):
        key = prefix << 21 | block[unit, at]
        step = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        on = np.flatnonzero(keys[step] == key)
        unit, at, prefix = unit[on], at[on], leads[step[on]]
        ends = np.flatnonzero((ids[prefix] >= 0) & (at >= low - first))
        place = at[ends] + first - low, unit[ends], longest - size
        gain[place], kind[place] = scores[prefix[ends]], ids[prefix[ends]]
        more = np.flatnonzero(at + 1 < block.shape[1])
        unit, at, prefix = unit[more], at[more] + 1, prefix[more]
    return gain, kind


def _best_of(units: list[str], sizes: np.ndarray, model: str, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Ids of units that come in falling order of their lengths, one after the
    other, and how many each has."""
    longest, width = _prefixes(model)[-1], int(sizes[0])
    chars = np.zeros((len(units), width), np.int32)
    chars[np.arange(width) < sizes[:, None]] = np.frombuffer("".join(units).encode("utf-32-le", "surrogatepass"), np.uint32) + 1
    total = np.full((len(units), longest + width + 1), -np.inf)
    total[:, longest] = 0
    size_of, id_of = np.zeros(chars.shape, np.int8), np.zeros(chars.shape, np.int32)
    every = np.arange(len(units))
    for low in range(0, width, WINDOW):
        high = min(low + WINDOW, width)
        gain, kind = _edges(chars, low, high, model, least)
        for k in range(low, high):
            live = every[: np.searchsorted(-sizes, -k)]
            sums = total[: len(live), k + 1 : k + 1 + longest] + gain[k - low, : len(live)]
            best = sums.argmax(axis=1)  # of equal sums the first, which is the longest piece
            total[: len(live), longest + k + 1] = sums[live, best]
            size_of[: len(live), k] = longest - best
            id_of[: len(live), k] = kind[k - low, live, best]
    back, at, unit = [], sizes - 1, every
    while len(unit):
        back.append((unit, id_of[unit, at], chars[unit, at]))
        at = at - size_of[unit, at]
        unit, at = unit[at >= 0], at[at >= 0]
    unit, ids, char = (np.concatenate(x[::-1]) for x in zip(*back))
    order = np.argsort(unit, kind="stable")
    unit, ids, code = unit[order], ids[order], char[order] - 1
    # A character without a piece as its UTF-8 bytes.
    n = np.where(ids >= 0, 1, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000))
    of = np.repeat(np.arange(len(n)), n)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)
    bits = code[of] >> 6 * (n[of] - 1 - nth)
    byte = np.where(nth > 0, bits & 0x3F | 0x80, bits | np.array([0, 0, 0xC0, 0xE0, 0xF0])[n[of]])
    return np.where(ids[of] >= 0, ids[of], byte + _first_byte(model)), np.bincount(unit[of], minlength=len(units))


def best_ids(units: list[str], model: str = MODEL) -> list[bytes]:
    """The packed ids of each unit, along the same best path as :func:`encode_units`."""
    least, kind = _least(model), _wide(model)
    sizes = np.array([len(u) for u in units], np.int64)
    order = np.argsort(-sizes, kind="stable")
    found, at = [b""] * len(units), 0
    while at < len(order):
        part = order[at : at + max(1, CELLS // int(sizes[order[at]]))]
        at += len(part)
        ids, counts = _best_of([units[k] for k in part], sizes[part], model, least)
        packed, ends = ids.astype(kind).tobytes(), (np.cumsum(counts) * kind().itemsize).tolist()
        for k, start, end in zip(part.tolist(), [0, *ends], ends):
            found[k] = packed[start:end]
    return found


@functools.lru_cache(4)
def _wide(model: str) -> type:
    """The type of packed ids."""
    return np.uint16 if processor(model).get_piece_size() <= 2**16 else np.uint32


def _speller(model: str) -> Callable[[np.ndarray], str]:
    """A function that gives the text of ids."""
    sp = processor(model)
    first, blank = sp.piece_to_id("<0x00>"), BLANK.encode()
    forms = [bytes([i - first]) if sp.is_byte(i) else sp.id_to_piece(i).encode() for i in range(sp.get_piece_size())]

    def spell(ids: np.ndarray) -> str:
        raw = b"".join([forms[i] for i in ids.tolist()]).replace(blank, b" ")
        return (raw[1:] if raw.startswith(b" ") else raw).decode("utf-8", "replace")

    return spell


def _slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of few rows, as ids take several times the room of what they come from."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS):
            yield batch.slice(at, ROWS)


def _encoded(model: str, hot, spelled: bool):
    """Ids of the documents; adds the text they decode to if asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, kind, known = unit_cutter(model), _wide(model), dict(hot.value)
        spell = _speller(model) if spelled else None
        most = len(known) + HELD
        for batch in _slices(batches):
            units = [cut(v.as_py()) for v in batch.column(2)]
            fresh = list(set().union(*units).difference(known))
            if len(known) + len(fresh) > most:
                known = dict(hot.value)
                fresh = list(set().union(*units).difference(known))
            known.update(zip(fresh, best_ids(fresh, model)))
            lists = [np.frombuffer(b"".join(map(known.__getitem__, u)), kind) for u in units]
            ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
            values = pa.array(np.concatenate([np.zeros(0, kind), *lists]).astype(np.int32))
            columns, names = [*batch.columns[:2], pa.ListArray.from_arrays(pa.array(ends), values)], ["doc_id", "text_key", "ids"]
            if spell:
                columns, names = [*columns, pa.array([spell(ids) for ids in lists], pa.string())], [*names, "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    return run


def encode(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text", spelled: bool = False) -> DataFrame:
    """``doc_id, text_key, ids`` for every row; ``text_key`` is the text's hash.
    With ``spelled`` also ``decoded``, made in the same pass."""
    spark = docs.sparkSession
    ship(spark)
    counted = stored(count_units(docs, model, text), "unit-counts")
    kind = _wide(model)
    units = encode_units(frequent(counted, HOT_UNITS), model).select("piece", "ids").collect()
    hot = spark.sparkContext.broadcast({r.piece: np.array(r.ids, kind).tobytes() for r in units})
    id_type = docs.schema[doc_id].dataType.simpleString()
    keyed = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(F.col(text)).alias("text_key"), F.col(text).cast("string").alias("text"))
    return keyed.mapInArrow(_encoded(model, hot, spelled), f"doc_id {id_type}, text_key long, ids array<int>" + ", decoded string" * spelled)


def _decoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spell = _speller(model)
        for batch in _slices(batches):
            texts = [spell(ids.values.to_numpy(zero_copy_only=False)) for ids in batch.column("ids")]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, "decoded"])

    return run


def decode(encoded: DataFrame, model: str = MODEL) -> DataFrame:
    """Adds ``decoded`` to a table with ``ids``."""
    ship(encoded.sparkSession)
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema.fields)
    return encoded.mapInArrow(_decoded(model), f"{fields}, decoded string")


def with_pieces(docs: DataFrame, model: str = MODEL, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_pieces, decodes_back, ids`` per row: its ids, their number,
    and whether they decode to the text."""
    encoded = encode(docs, model, doc_id, text, spelled=True)
    whole = F.xxhash64("decoded") == F.coalesce(F.nullif("text_key", F.xxhash64(F.lit(None).cast("string"))), F.xxhash64(F.lit("")))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_pieces"), whole.alias("decodes_back"), "ids")


@query("op8_sentencepiece")
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_pieces(table(spark, sf_dir, "documents"))
