from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from speechlake.llm import supportvectors as sv

SF = "/root/testdata/sf0.1"


def grams(text):
    """The n-grams themselves, with the shapes spelt out character by character."""
    words = text.split()
    shapes = []
    for k, w in enumerate(words):
        kinds = ["A" if "A" <= c <= "Z" else "a" if "a" <= c <= "z" or ord(c) > 127 else "0" if c.isdigit() else c for c in w]
        shapes.append("=" if k and w == words[k - 1] else "".join(c for i, c in enumerate(kinds) if not i or c != kinds[i - 1]))
    out = {(n, *shapes[i : i + n]) for n in (1, 2, 3) for i in range(len(shapes) - n + 1)}
    return out | {("w", *words[i : i + n]) for n in (1, 2) for i in range(len(words) - n + 1)}


def test_features_are_the_ngrams(monkeypatch):
    draw = random.Random(1)
    words = ["la", "La", "LA!!", "x1", "22", "é,", "|", "la$$"]
    lost = 0
    for _ in range(60):
        text = " ".join(draw.choice(words) for _ in range(draw.randrange(40)))
        whole = sv.features(text, sv.Words())
        assert (np.diff(whole) > 0).all()
        lost += len(grams(text)) - len(whole)
        with monkeypatch.context() as small:
            small.setattr(sv, "STRETCH", 4)
            small.setattr(sv, "HELD", 2)
            assert np.array_equal(sv.features(text, sv.Words()), whole)
    assert 0 <= lost <= 3  # n-grams that share a slot
    assert len(sv.features(None, sv.Words())) == len(sv.features(" ", sv.Words())) == 0
    assert len(sv.features("w " * 2_000_000, sv.Words())) == 8


def test_ratios_equal_brute_force(documents, spark):
    draw = random.Random(2)
    rows = [(i, " ".join(draw.choice("abcdeFGH") for _ in range(draw.randrange(9)))) for i in range(200)]
    rows += [(None, "zz"), (3, "a b"), (4, None), (5, "a b")]
    labels = [(i, draw.randrange(2)) for i in range(150)] + [(7, 0), (7, 1), (8, None), (None, 1), (9, 2)]
    table = spark.createDataFrame(labels, "doc_id long, quality int").selectExpr("*", "1 AS good", "2 AS fold")
    found = sv.labelled(documents(rows), table)
    ratio, n_good, n_bad = sv.log_ratios(found)
    said = {}
    for i, q in labels:
        said.setdefault(i, []).append(q)
    agreed = {i: {x for x in q if x is not None} for i, q in said.items()}
    learnt = [(t, min(agreed[i])) for i, t in rows if agreed.get(i) in ({0}, {1}) and i is not None and zlib.crc32(str(i).encode()) % 5]
    assert (n_good, n_bad) == (sum(q for _, q in learnt), sum(1 - q for _, q in learnt))
    counts = np.zeros((2, 1 << sv.BITS))
    for t, q in learnt:
        counts[q, sv.features(t, sv.Words())] += 1
    want = np.log((counts[1] + 1) / (n_good + 2) / ((counts[0] + 1) / (n_bad + 2)))
    assert np.allclose(ratio, want)


def test_texts_without_a_label_stay_where_they_are(documents, spark):
    rows = documents([(i, "a b") for i in range(-2000, 2000)] + [(None, "c")]).withColumnRenamed("doc_id", "_id")
    own = [*range(-1500, -1400), *range(7, 2000, 9), 5000, None]
    labels = spark.createDataFrame([(i, 1) for i in own], "doc_id long, quality int")
    kept = {r["_id"] for r in sv.likely_labelled(rows, labels).collect()} - {None}
    asked = {i for i in own if i is not None and i < 2000}
    assert asked <= kept and len(kept - asked) <= 5
    narrow = labels.withColumn("doc_id", labels.doc_id.cast("int"))
    assert sv.likely_labelled(rows, narrow).join(narrow, rows["_id"] == narrow["doc_id"]).count() == len(asked)
    docs = documents([(i, "a b") for i in range(-2000, 2000)])
    with_all, few = sv.labelled(docs, narrow), sv.labelled(docs, labels)
    assert sorted(map(tuple, with_all.collect())) == sorted(map(tuple, few.collect()))


def test_descent_reaches_the_optimum():
    draw = np.random.default_rng(5)
    slots = [np.sort(draw.choice(30, 6, replace=False)) for _ in range(80)]
    signs, ratio = draw.choice([-1.0, 1.0], 80), draw.normal(size=30)
    weights, bias = sv.descent(slots, signs, ratio, 0.5, 3000)
    x = np.zeros((80, 31))
    for row, s in zip(x, slots):
        row[s] = sv.scaled(ratio, s)
    x[:, 30] = 1

    def value(w):
        return w @ w / 2 + 0.5 * np.maximum(1 - signs * (x @ w), 0).sum()

    own = np.append(weights, bias)
    best = value(own)
    assert all(value(own + draw.normal(size=31) * s) >= best - 1e-6 for s in (1e-3, 1e-2, 0.1, 1) for _ in range(200))


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{n}.parquet") for n in ("documents", "labels"))
    for fit_rows in (sv.FIT_ROWS, 500):
        got = sv.score(docs, labels, fit_rows).join(labels, "doc_id").where("held_out").select("doc_id", "score", "quality").collect()
        assert all(zlib.crc32(str(r.doc_id).encode()) % 5 == 0 for r in got) and len(got) > 500
        good, bad = ([r.score for r in got if r.quality == q] for q in (1, 0))
        above = sum(sum(g > b for g in good) for b in bad) / (len(good) * len(bad))
        right = sum((r.score >= sv.THRESHOLD) == (r.quality == 1) for r in got) / len(got)
        assert above > 0.99 and right > 0.98


def test_edges(documents, spark):
    none = spark.createDataFrame([], "doc_id long, quality int")
    rows = [(1, "a"), (None, None), (2, ""), (2, "")]
    assert sorted(r.score for r in sv.score(documents(rows), none).collect()) == [0.5] * 4
    one = spark.createDataFrame([(i, 1) for i in range(20)], "doc_id long, quality int")
    scores = {r.score for r in sv.score(documents([(i, "a b") for i in range(20)]), one).collect()}
    assert len(scores) == 1 and min(scores) > 0.8
    both = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")
    got = sv.score(documents([(i, "GOOD!" if i % 2 else "bad") for i in range(60)] + [(None, None), (100, "")]), both).collect()
    assert all(0 <= r.score <= 1 for r in got) and len(got) == 62
    assert min(r.score for r in got if r.doc_id and r.doc_id < 60 and r.doc_id % 2) > 0.5
    assert next(r.held_out for r in got if r.doc_id is None)
    assert sv.score(documents([]), both).count() == 0
