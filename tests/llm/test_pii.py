from __future__ import annotations

import re

from conftest import prose
from pyspark.sql import functions as F

from speechlake.llm import pii

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def valid(kind, value):
    digits = re.sub("[^0-9]", "", value)
    luhn = sum(sum(divmod(int(c) * (1 + i % 2), 10)) for i, c in enumerate(digits[::-1])) % 10 == 0
    return {
        "email": True,
        "ip": kind == "ip" and all(int(p) <= 255 for p in value.split(".")),
        "card": 14 <= len(digits) <= 19 and luhn,
        "phone": 10 <= len(digits) <= 15,
    }[kind]


def base(text):
    found = [(m.start(), n, m.end(), k) for n, (k, p) in enumerate(PATTERNS.items()) for m in re.finditer(p, text or "") if valid(k, m[0])]
    return ",".join(f"{k}:{a}:{e}" for a, _, e, k in sorted(found))


TEXTS = [
    "a@b@c.de x1.2.3.4.5.6.7.8 +1 (234) 567-8901 4111 1111 1111 1111 éé 😀 z@y.co",
    "1.2.3.256 001.02.3.4 a.b@c-d.e_f@g.h",
    None,
    "",
    "7" * 5000,
    "x" * 100000 + "@",
    "4111111111111111-4111111111111111",
    "+1234567890 and +12345678901234567 +1 2",
]


def test_base_spans(documents):
    docs = documents([(i, t) for i, t in enumerate(TEXTS)] + [(0, TEXTS[0])])
    got = pii.with_spans(docs).select("text", pii._joined(F.col("_base")).alias("j")).collect()
    assert len(got) == len(TEXTS) + 1
    assert all(r.j == base(r.text) for r in got)
    assert pii.sanitise(documents([])).count() == 0


def test_terms_that_reveal_are_masked(documents):
    near = [f"{prose(i, 20)} Zanzibar writes to john@doe.org from {prose(50 + i, 20)}" for i in range(3)]
    rows = [(i, t) for i, t in enumerate(near)] + [(10, "Zanzibarian alone"), (11, prose(7, 50)), (12, "from and to " * 9)]
    rows += [(20 + i, f"writes {prose(100 + i, 9)}") for i in range(9)]
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    assert all("john@doe.org" not in clean[i] and "[EMAIL]" in clean[i] and "Zanzibar" not in clean[i] for i in range(3))
    assert all("writes" in clean[i] for i in range(3))  # most of its uses are elsewhere
    assert all(clean[d] == t for d, t in rows if d >= 10)
    assert pii.sanitise(documents(rows)).columns == documents(rows).columns


def test_short_far_and_numbered_terms_are_masked(documents):
    rows = [(i, f"Li R2D2 {prose(i, 60)} mail to li@doe.org please") for i in range(3)]
    rows += [(10 + i, f"mail to nobody please {prose(100 + i, 30)}") for i in range(12)]
    clean = {r.doc_id: r.text for r in pii.sanitise(documents(rows)).collect()}
    for i in range(3):
        words = clean[i].split()
        assert "[EMAIL]" in words and "mail" in words and "please" in words
        assert "Li" not in words and "R2D2" not in words
    assert all(clean[d] == t for d, t in rows if d >= 10)


def test_the_union_of_overlapping_spans_is_masked(documents):
    card = next(c for c in (f"24 5555 5555 5555 55{k:02d}" for k in range(100)) if valid("card", c))
    text = f"see 10.0.0.{card} now"
    assert base(text).count(":") == 4
    clean = pii.sanitise(documents([(1, text)])).first().text
    assert clean == "see [IP][CARD] now"
