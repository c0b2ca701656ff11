from __future__ import annotations

import math
import re
from collections import Counter

import pytest
from conftest import prose

from speechlake.llm import scoring


def brute(texts):
    docs = [[w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or "")) if w] for t in texts]
    words, pairs = Counter(w for d in docs for w in d), Counter(p for d in docs for p in zip(d, d[1:]))
    before, total = Counter(w for d in docs for w in d[:-1]), sum(len(d) for d in docs)
    steps = lambda x: round(math.log2(x) * scoring.UNIT)
    out = []
    for d in docs:
        score = steps(words[d[0]] / total) if d else 0
        for a, b in zip(d, d[1:]):
            score += steps(pairs[a, b] / before[a]) if pairs[a, b] >= 2 else steps(words[b] / total) + steps(scoring.BACKOFF)
        out.append((len(d), score))
    return out


@pytest.mark.parametrize("hot", [scoring.HOT_WORDS, 20, 0])
def test_scores(documents, monkeypatch, hot):
    monkeypatch.setattr(scoring, "HOT_WORDS", hot)
    monkeypatch.setattr(scoring, "BUCKET", 500)
    texts = [None, "", "a b a b c", "a b a b c", "A\tb  x", prose(1, 400), prose(1, 300), prose(2, 50), "the " * 300]
    ids = [1, 1, 2, 2, None, 3, 4, 5, 6]
    got = scoring.scores(documents(list(zip(ids, texts)))).collect()
    assert sorted((str(r.doc_id), r.n_words, r.steps) for r in got) == sorted((str(i), *x) for i, x in zip(ids, brute(texts)))


def test_no_rows(documents):
    assert scoring.scores(documents([])).count() == 0
