from __future__ import annotations

import itertools
import random
import re

import pytest

from speechlake.llm import filteraudit
from speechlake.sources.scratch import scratch_path

SCHEMA = "doc_id long, text string, lang string, bits int, n long, held boolean, part string, digest string"
PROSE = " ".join(f"w{i}" for i in range(120))
TEXTS = [PROSE, PROSE + " #", "A " + PROSE.upper(), " ".join(["same"] * 150), "", None, "short", "ÀÉ " + PROSE, "x y " * 100, "C" * 300_000]


def fails(doc, docs):
    doc_id, text, _ = doc
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    out = ["A"] * (len(words) < 100) + ["B"] * (100 * len(set(words)) < 80 * len(words))
    out += ["C"] * (100 * len(re.findall("[A-Z]", text)) > 10 * len(text)) + ["D"] * bool(re.search("[#$%&*|]", text))
    copies = [d for d, t, _ in docs if d is not None and (t or "") == text]
    return set(out + ["E"] * (doc_id is not None and bool(copies) and min(copies) < doc_id))


def brute(docs, labels):
    good = {d for d, q, _ in labels if q == 1}
    toxic = {d for d, _, t in labels if t == 1}
    failed = [(part or "", doc_id, fails((doc_id, text, part), docs)) for doc_id, text, part in docs]
    rows = []
    for part in sorted({p for p, *_ in failed}):
        own = [(d, f) for p, d, f in failed if p == part]
        shapley = dict.fromkeys("ABCDE", 0)
        made = []
        for order in itertools.permutations("ABCDE"):
            left = own
            for step, letter in enumerate(order, 1):
                gone = [x for x in left if letter in x[1]]
                left = [x for x in left if letter not in x[1]]
                redundant = sum(letter in f for _, f in own) - len(gone)
                unique = sum(f == {letter} for _, f in own)
                shapley[letter] += len(gone)
                lost = [sum(d in s for d, _ in gone) for s in (good, toxic)]
                made.append([part, "".join(order), step, len(left), len(gone), redundant, unique, *lost])
        rows += [(*m, shapley[m[1][m[2] - 1]]) for m in made]
    return sorted(rows)


def write(spark, path, rows):
    wide = [(d, t, p, -1, -1, False, "z", "z") for d, t, p in rows]
    spark.createDataFrame(wide, SCHEMA).coalesce(1).write.mode("append").parquet(path)


@pytest.fixture
def labels(spark):
    rows = [(1, 1, 0), (1, 0, 1), (2, None, 1), (3, 1, 1), (5, 1, 0), (None, 1, 1), (9, 0, 0), (40, 1, 1)]
    return rows, spark.createDataFrame(rows, "doc_id long, quality int, toxic int").selectExpr("*", "7 AS bits", "'x' AS _id")


def test_smaller_ids_retract_over_batches_and_restarts(spark, labels):
    rows, table = labels
    draw = random.Random(3)
    docs = [(draw.choice([None, *range(60)]), draw.choice(TEXTS), draw.choice(["en", "de", None, ""])) for _ in range(150)]
    docs += [(draw.randrange(60), PROSE, "en") for _ in range(100)] + [(0, PROSE, "de"), (0, PROSE, "de"), (0, PROSE, "fr")]
    path, out = scratch_path(spark, "audit-in"), scratch_path(spark, "audit-out")
    parts = [docs[i::6] for i in range(6)]
    for part in parts[:4]:
        write(spark, path, part)
    known = filteraudit.label_bits(table)
    filteraudit.run_counters(spark, path, known, out, 3, 1)
    some = [d for part in parts[:4] for d in part]
    assert sorted(map(tuple, filteraudit.audit(filteraudit.counters(spark, out)).collect())) == brute(some, rows)
    for part in parts[4:]:  # the stream goes on from its state
        write(spark, path, part)
    filteraudit.run_counters(spark, path, known, out, 3, 1)
    assert spark.read.parquet(f"{out}/counters").select("batch").distinct().count() == 6
    assert filteraudit.counters(spark, out).groupBy().sum("n").first()[0] == len(docs)
    assert sorted(map(tuple, filteraudit.audit(filteraudit.counters(spark, out)).collect())) == brute(docs, rows)


def test_descending_ids_retract_each_time(spark, labels):
    path = scratch_path(spark, "audit-down")
    docs = [(20 - i, PROSE, "en") for i in range(5)]
    for doc in docs:
        write(spark, path, [doc])
    got = filteraudit.run_audit(spark, path, labels[1])
    assert sorted(map(tuple, got.collect())) == brute(docs, labels[0])
    first = got.where("filter_order = 'EABCD' AND step = 1").first()
    assert (first.kept, first.removed) == (1, 4)


def test_no_rows(spark, labels):
    path = scratch_path(spark, "audit-none")
    write(spark, path, [])
    assert filteraudit.run_audit(spark, path, labels[1]).count() == 0
