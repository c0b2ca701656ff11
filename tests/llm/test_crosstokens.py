from __future__ import annotations

import hashlib
from collections import Counter

import public_tokenizers
import sentencepiece
from conftest import prose
from tokenizers import Tokenizer

from speechlake.llm import crosstokens

TEXTS = [
    "Hello  world\nfoo é 日本🙂 it's 123",
    "x<|endoftext|>y <s> </s> <0x41> <unk>",
    "  a ",
    " ",
    "",
    None,
    "a literal ▁ changes its bytes",
    "naïve café — “quotes” İstanbul ﬁ Ⅷ   \t",
    "x" * 700 + "ab",
    prose(1, 900),
    prose(1, 900),
    "the cat , the dog's end .\r\n" * 40,
    "Erach einver enungschst die erözukeit " * 30,
]
NAMES = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


def brute(texts):
    """Every link by comparing all ends of one side with all of the other."""
    a = Tokenizer.from_file(public_tokenizers.path(crosstokens.FIRST))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path(crosstokens.SECOND))
    letters = crosstokens._letters()

    def spans(tokens):
        out, at = [], 0
        for i, x in tokens:
            out.append((i, at, at + len(x)))
            at += len(x)
        return out, b"".join(x for _, x in tokens)

    found = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        left, x = spans([(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + (text or ""), add_special_tokens=False).ids])
        named = [(i, b.id_to_piece(i)) for i in b.encode(text or "")]
        right, y = spans([(i, bytes.fromhex(p[3:5]) if b.is_byte(i) else p.replace("▁", " ").encode()) for i, p in named])
        if not text or x != whole or y != whole:
            found.append(None)
            continue
        ends = sorted({e for *_, e in left} & {e for *_, e in right})
        cut = [
            "|".join(",".join(str(i) for i, _, e in side if start < e <= end) for side in (left, right))
            for start, end in zip([0, *ends], ends)
        ]
        links = [(i, j) for i, _, e in left for j, _, f in right if e == f]
        found.append((len(left), len(right), len(cut), links, hashlib.sha256(";".join(cut).encode()).hexdigest()))
    count = Counter(link for f in found if f for link in f[3])
    best: Counter = Counter()
    for (_, j), n in count.items():
        best[j] = max(best[j], n)
    rows = []
    for i, f in enumerate(found):
        if f is None:
            rows.append((i, 0, 0, 0, 0, 0, 0, ""))
        else:
            top = sum(count[link] == best[link[1]] for link in f[3])
            rows.append((i, *f[:3], len(f[3]), top, sum(count[link] for link in f[3]), f[4]))
    return rows


def test_links_equal_brute_force(documents, monkeypatch):
    want = brute(TEXTS)
    assert sum(r[1] == 0 for r in want) == 3 and any(r[3] < r[2] for r in want)
    for hot, held in ((crosstokens.HOT_PAIRS, crosstokens.HELD), (3, 5), (0, 5)):
        monkeypatch.setattr(crosstokens, "HOT_PAIRS", hot)
        monkeypatch.setattr(crosstokens, "HELD", held)
        monkeypatch.setattr(crosstokens, "CUT", 1 << 20 if hot else 300)
        got = crosstokens.aligned(documents(list(enumerate(TEXTS))))
        assert got.columns == NAMES
        assert sorted(map(tuple, got.collect())) == want


def test_repeated_and_null_ids_and_empty_tables(documents):
    rows = [(None, "a b"), (None, "a b"), (7, "a b")]
    got = crosstokens.aligned(documents(rows)).collect()
    assert sorted((r.doc_id or 0, r.n_links, r.count_sum) for r in got) == [(0, 2, 6), (0, 2, 6), (7, 2, 6)]
    assert crosstokens.aligned(documents([])).count() == 0


def test_no_token_crosses_units():
    t = crosstokens.tokenizers(crosstokens.FIRST, crosstokens.SECOND)
    text = " ".join(x or "" for x in TEXTS if "▁" not in (x or "")) * 3
    units = crosstokens.units_of(text)
    assert " ".join(units) == text and len(units) > 1000
    a, b = t.encode(units)
    assert sum(a, []) == t.a.encode(" " + text, add_special_tokens=False).ids and sum(b, []) == t.b.encode(text)


def test_long_texts(documents):
    texts = ["w" * 2000 + " end", "日本語" * 500, " ".join(f"n{i % 500}" for i in range(1500))]
    assert sorted(map(tuple, crosstokens.aligned(documents(list(enumerate(texts)))).collect())) == brute(texts)
