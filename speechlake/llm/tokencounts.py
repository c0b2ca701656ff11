"""Token counts without token ids.

A tokenizer cuts a text into pre-tokens and then each pre-token into pieces by
itself. So the pieces are counted once per distinct pre-token, and a document's
count is the sum over its pre-token frequencies. The most frequent
``HOT_PIECES`` short pre-tokens (a fixed number, so a bounded table) are
broadcast; the rest of a document's pre-tokens, which are rare by construction,
meet their counts in a shuffled join.

Defined results: null and empty texts have no bytes and no tokens; special
strings in a text are one token each, as the library finds them; repeated rows
are counted each by itself; an empty table gives no rows; other columns are not
looked at.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from speechlake.llm.common import most_frequent, query, ship, table
from speechlake.sources.scratch import stored

TOKENIZER = "word_bpe_49k.json"
LIMIT = 2048
HOT_PIECES = 65536
HOT_LENGTH = 32
# Distinct pre-tokens that a task holds before it passes them on.
HELD = 500_000

# The rule of the tokenizer file that the direct cut below follows.
WORD_RULE = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
# Below this character the classes of letters, numbers and spaces are as old as
# Unicode itself, no normal form changes anything and lower case stays below it
# (but for the dotted capital I), so ``re`` can cut.
PLAIN = 0x180
_SPACES = "\\x09-\\x0d\\x20\\x85\\xa0"


def _class(kind: str) -> str:
    return "".join(re.escape(chr(c)) for c in range(PLAIN) if unicodedata.category(chr(c))[0] == kind)


def pretokenizer(name: str) -> tuple[Callable[[str], list[str]], Callable[[str], int], re.Pattern | None]:
    """Functions of a tokenizer file: a text's pre-tokens, a pre-token's number
    of pieces, and the pattern of its special strings."""
    import public_tokenizers
    from tokenizers import Tokenizer, pre_tokenizers

    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    with open(path, encoding="utf-8") as file:
        said = json.load(file)
    specials = sorted((t["content"] for t in said["added_tokens"]), key=len, reverse=True)
    special = re.compile("|".join(map(re.escape, specials))) if specials else None
    steps = (said["pre_tokenizer"] or {}).get("pretokenizers") or [{}]
    forms = [n["type"] for n in (said["normalizer"] or {}).get("normalizers", [])]
    direct = steps[0].get("pattern") == {"Regex": WORD_RULE} and forms == ["NFC", "Replace", "Lowercase"]
    letters, numbers = _class("L"), _class("N")
    plain = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{numbers}]|[^{_SPACES}{letters}{numbers}]+")
    beyond = re.compile(f"[^\x00-{chr(PLAIN - 1)}]|İ")

    def cut(text: str) -> list[str]:
        if direct and not beyond.search(text):
            return plain.findall(text.lower())
        shape = tokenizer.normalizer.normalize_str(text) if tokenizer.normalizer else text
        if tokenizer.pre_tokenizer is None:
            return [shape] if shape else []
        return [shape[a:b] for _, (a, b) in tokenizer.pre_tokenizer.pre_tokenize_str(shape)]

    as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
    bytewise = any(s.get("type") == "ByteLevel" for s in steps) or (said["pre_tokenizer"] or {}).get("type") == "ByteLevel"

    def pieces(piece: str) -> int:
        form = as_bytes.pre_tokenize_str(piece)[0][0] if bytewise else piece
        return len(tokenizer.model.tokenize(form))

    return cut, pieces, special


def _cut_all(name: str) -> Callable[[str | None], tuple[list[str], int]]:
    cut, _, special = pretokenizer(name)

    def run(text: str | None) -> tuple[list[str], int]:
        """Pre-tokens of a text and its number of special strings."""
        if not text:
            return [], 0
        if special is None or not special.search(text):
            return cut(text), 0
        parts = special.split(text)
        return [p for part in parts if part for p in cut(part)], len(parts) - 1

    return run


def _distinct(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = _cut_all(name)
        seen: Counter = Counter()

        def passed_on() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["piece", "n"])
            seen.clear()
            return out

        for batch in batches:
            for text in batch.column(0):
                seen.update(cut(text.as_py())[0])
                if len(seen) > HELD:
                    yield passed_on()
        yield passed_on()

    return run


def _count_pieces(name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _, pieces, _ = pretokenizer(name)
        for batch in batches:
            counts = pa.array([pieces(p.as_py()) for p in batch.column(0)], pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), counts], ["piece", "n", "tokens"])

    return run


def _frequencies(name: str, hot):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut, known = _cut_all(name), hot.value
        for batch in batches:
            sizes, sums, rare, counts, ends = [], [], [], [], [0]
            for value in batch.column(1):
                text = value.as_py()
                words, total = cut(text)
                for piece, n in Counter(words).items():
                    tokens = known.get(piece)
                    if tokens is None:
                        rare.append(piece)
                        counts.append(n)
                    else:
                        total += n * tokens
                sizes.append(len(text.encode("utf-8", "surrogatepass")) if text else 0)
                sums.append(total)
                ends.append(len(rare))
            lists = [pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(v, t)) for v, t in ((rare, pa.string()), (counts, pa.int64()))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(sums, pa.int64()), *lists], ["doc_id", "n_bytes", "n", "rare", "counts"]
            )

    return run


def vocabulary(docs: DataFrame, tokenizer: str = TOKENIZER, text: str = "text") -> DataFrame:
    """``piece, n, tokens``: every distinct pre-token, how often it occurs and
    how many pieces it has."""
    distinct = docs.select(F.col(text).cast("string")).mapInArrow(_distinct(tokenizer), "piece string, n long")
    counted = distinct.groupBy("piece").agg(F.sum("n").alias("n"))
    return counted.mapInArrow(_count_pieces(tokenizer), "piece string, n long, tokens long")


def frequent(pieces: DataFrame, most: int = HOT_PIECES) -> DataFrame:
    """The most frequent short pre-tokens, ``most`` at most."""
    return most_frequent(pieces.where(F.length("piece") <= HOT_LENGTH), most)


def count_tokens(docs: DataFrame, tokenizer: str = TOKENIZER, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_bytes, n_tokens`` for every row."""
    spark = docs.sparkSession
    ship(spark)
    pieces = stored(vocabulary(docs, tokenizer, text), "pieces")
    hot = spark.sparkContext.broadcast({r.piece: r.tokens for r in frequent(pieces).select("piece", "tokens").collect()})
    id_type = docs.schema[doc_id].dataType.simpleString()
    found = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string")).mapInArrow(
        _frequencies(tokenizer, hot), f"doc_id {id_type}, n_bytes long, n long, rare array<string>, counts array<long>"
    )
    # Written once, so a row keeps its number whatever is computed again.
    rows = stored(found.withColumn("row", F.monotonically_increasing_id()), "frequencies")
    rare = rows.select("row", F.explode(F.arrays_zip("rare", "counts")).alias("r")).select("row", F.col("r.rare").alias("piece"), F.col("r.counts").alias("k"))
    sums = rare.join(pieces.select("piece", "tokens"), "piece").select("row", (F.col("k") * F.col("tokens")).alias("n"))
    return (
        rows.select("row", "doc_id", "n_bytes", "n")
        .unionByName(sums, allowMissingColumns=True)
        .groupBy("row")
        .agg(F.max("doc_id").alias("doc_id"), F.max("n_bytes").alias("n_bytes"), F.sum("n").alias("n_tokens"))
        .drop("row")
    )


@query("op7_token_counts")
def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents")).withColumn("over_limit", F.col("n_tokens") > LIMIT)
