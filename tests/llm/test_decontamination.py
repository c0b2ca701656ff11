from __future__ import annotations

import re

from conftest import prose

from speechlake.llm import decontamination


def words_of(text):
    return [w for w in re.split("[\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]


def brute(docs, items):
    out = []
    for d, text in docs:
        words, hit, found = words_of(text), set(), set()
        for item, passage in items:
            w = words_of(passage)
            n = min(10, len(w))
            spans = {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if n else set()
            for i in range(len(words) - n + 1 if n else 0):
                if tuple(words[i : i + n]) in spans:
                    hit |= set(range(i, i + n))
                    found.add(item)
        out.append((str(d), len(words), len(hit), sorted(map(str, found))))
    return sorted(out)


def test_every_shared_window_is_found(spark, documents):
    passages = [(1, prose(5, 60)), (2, prose(6, 10)), (3, "Tiny item here"), (3, "Tiny item here"), (4, "..."), (5, None), (10, "one two three four five six seven eight nine")]
    docs = [
        (1, prose(9, 200) + " " + prose(5, 60)[40:140].upper() + "."),
        (2, prose(6, 10).replace(" ", ", ") + " tail"),
        (2, prose(6, 10).replace(" ", ", ") + " tail"),
        (3, "a tiny, item: HERE tiny item here"),
        (None, "one two three four five six seven eight nine ten"),
        (4, None),
        (5, ""),
        (6, prose(8, 400)),
        (7, " ".join(prose(5, 60).split()[:9])),
    ]
    items = spark.createDataFrame(passages, "item_id long, text string")
    counted, leaks = decontamination.find_leaks(documents(docs), items)
    found = {(str(r.doc_id), r.text_key): (r.n_hit, sorted(map(str, r["items"]))) for r in leaks.collect()}
    got = {(str(r.doc_id), r.n_words, *map(str, found.get((str(r.doc_id), r.text_key), (0, [])))) for r in counted.collect()}
    assert got == {(d, n, str(h), str(i)) for d, n, h, i in brute(docs, passages)}
    kept = decontamination.drop_leaks(documents(docs), items)
    assert sorted(r.doc_id for r in kept.collect()) == [4, 5, 6, 7] and kept.columns == documents(docs).columns


def test_no_items_and_no_documents(spark, documents):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontamination.drop_leaks(documents([(1, "a b")]), none).count() == 1
    some = spark.createDataFrame([(1, "a b")], "item_id long, text string")
    assert decontamination.drop_leaks(documents([]), some).count() == 0


def test_items_without_an_id_count_as_one(spark, documents):
    items = spark.createDataFrame([(None, "one two"), (None, "three"), (4, "three")], "item_id long, text string")
    leaks = decontamination.find_leaks(documents([(1, "One two, three."), (2, "one"), (3, "x " * 50_000 + "three")]), items)[1]
    assert {r.doc_id: (r.n_hit, sorted(r["items"], key=str)) for r in leaks.collect()} == {1: (3, [4, None]), 3: (1, [4, None])}
