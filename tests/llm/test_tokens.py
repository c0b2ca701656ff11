from __future__ import annotations

import functools
import random

import numpy as np
import public_tokenizers
from conftest import prose
from tokenizers import Tokenizer

from speechlake.llm import pieces, tokencounts

TEXTS = [
    "Hello  world\nfoo é 日本🙂 it's 123",
    "x<|endoftext|>y <|startoftext|> <|ENDOFTEXT|>",
    "  a ",
    " ",
    "",
    None,
    "naïve café — “quotes” İstanbul ﬁ Ⅷ",
    "x" * 700 + "ab",
    prose(1, 900),
    prose(1, 900),
    "a\tb\r\nc\u00a0d",
]


def test_counts_equal_the_library(documents):
    library = Tokenizer.from_file(public_tokenizers.path(tokencounts.TOKENIZER))
    want = sorted((i % 8, len((t or "").encode()), len(library.encode(t or "", add_special_tokens=False).ids)) for i, t in enumerate(TEXTS))
    docs = documents([(i % 8, t) for i, t in enumerate(TEXTS)])
    assert sorted(map(tuple, tokencounts.count_tokens(docs).collect())) == want
    assert tokencounts.count_tokens(documents([])).count() == 0


def test_rare_pretokens_take_the_join(documents, monkeypatch):
    library = Tokenizer.from_file(public_tokenizers.path(tokencounts.TOKENIZER))
    monkeypatch.setattr(tokencounts.frequent, "__defaults__", (5,))
    docs = documents(list(enumerate(TEXTS)))
    want = {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in enumerate(TEXTS)}
    assert {r.doc_id: r.n_tokens for r in tokencounts.count_tokens(docs).collect()} == want


def test_plain_cut_equals_the_library():
    library = Tokenizer.from_file(public_tokenizers.path(tokencounts.TOKENIZER))
    cut, count, _ = tokencounts.pretokenizer(tokencounts.TOKENIZER)
    for c in map(chr, range(tokencounts.PLAIN)):
        for text in (f"a{c}b", f"!{c}?", f"1{c}2", f"'{c} x", f"a{c}'S{c}"):
            assert sum(map(count, cut(text))) == len(library.encode(text, add_special_tokens=False).ids)


def _viterbi(model):
    known = {p: (i, s) for p, i, s in pieces.piece_list(model)}
    longest, least = max(map(len, known)), min(s for _, s in known.values() if s > -1e8) - 10
    byte = pieces.processor(model).piece_to_id("<0x00>")

    @functools.lru_cache(None)
    def of(unit):
        best = [(0.0, -1, [])] + [None] * len(unit)
        for end in range(1, len(unit) + 1):
            for start in range(max(0, end - longest), end):
                piece = unit[start:end]
                if piece in known:
                    ids, score = [known[piece][0]], known[piece][1]
                elif end == start + 1:
                    ids, score = [byte + b for b in piece.encode()], least
                else:
                    continue
                total = best[start][0] + score
                if best[end] is None or total > best[end][0]:
                    best[end] = (total, start, ids)
        out, end = [], len(unit)
        while end:
            out, end = best[end][2] + out, best[end][1]
        return out

    return of


def test_lattice_is_viterbi_and_decodes_back(documents, monkeypatch):
    best, cut = _viterbi(pieces.MODEL), pieces.unit_cutter(pieces.MODEL)
    want = {i: [x for unit in cut(t) for x in best(unit)] for i, t in enumerate(TEXTS)}
    library = pieces.processor(pieces.MODEL)
    for hot in (pieces.HOT_UNITS, 3):
        monkeypatch.setattr(pieces, "HOT_UNITS", hot)
        got = pieces.decode(pieces.encode(documents(list(enumerate(TEXTS))))).collect()
        assert {r.doc_id: r.ids for r in got} == want
        assert all(r.decoded == (TEXTS[r.doc_id] or "") == library.decode(r.ids) for r in got)
    assert pieces.with_pieces(documents([])).count() == 0
    assert all(r.decodes_back for r in pieces.with_pieces(documents(list(enumerate(TEXTS)))).collect())


def test_rare_units_are_encoded_where_they_stand(documents):
    """No shuffle carries documents, or pairs of a document and a unit."""
    docs = documents([(i, prose(i, 200)) for i in range(20)])
    plan = pieces.encode(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Join" not in plan


def test_units_of_any_kind_take_the_best_path(monkeypatch):
    best, draw = _viterbi(pieces.MODEL), random.Random(3)
    signs = ["▁", "a", "e", "th", "ing", "é", "日", "🙂", "\0", "ß", "x", "\U0010ffff", "́"]
    units = ["".join(draw.choice(signs) for _ in range(draw.randrange(1, 40))) for _ in range(300)] + ["the" * 500, "▁" * 90, "a"]
    unpacked = lambda found: [np.frombuffer(ids, np.uint16).tolist() for ids in found]
    assert unpacked(pieces.best_ids(units)) == [best(u) for u in units]
    monkeypatch.setattr(pieces, "CELLS", 64)
    monkeypatch.setattr(pieces, "WINDOW", 5)
    assert unpacked(pieces.best_ids(units)) == [best(u) for u in units]
    assert pieces.best_ids([]) == []


def test_a_unit_of_a_million_letters():
    unit = "information" * 90_910
    (ids,) = pieces.best_ids([unit])
    assert pieces.processor(pieces.MODEL).decode(np.frombuffer(ids, np.uint16).tolist()) == unit
