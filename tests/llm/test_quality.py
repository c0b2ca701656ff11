from __future__ import annotations

import re

from conftest import *  # noqa: F403
from hypothesis import given, settings
from hypothesis import strategies as st

from speechlake.llm import quality


def brute(text):
    text = text or ""
    words = [w for w in re.split("[\x20\x09-\x0d]+", text) if w]
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    inside = {i + k for i, g in enumerate(grams) if grams.count(g) > 1 for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), len(lines), len(lines) - len(set(lines)), len(inside)


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet="ab é\n\t\x0b\xa0#<", max_size=80))
def test_measures(text):
    assert quality.measure(text) == brute(text)


def test_null_and_empty():
    assert quality.measure(None) == quality.measure("") == (0,) * 6


def test_hosts_decide(spark):
    good, bad = " ".join(f"word{i}" for i in range(60)), "short"
    rows = [(i, good, "clean") for i in range(20)] + [(100 + i, bad if i else good, "junk") for i in range(20)]
    rows += [(200, good, None), (201, None, None), (202, "", "clean"), (200, good, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").selectExpr("*", "1 AS n_docs", "2 AS host")
    kept = sorted(r.doc_id for r in quality.keep_documents(docs).collect())
    assert kept == [*range(20), 200, 200]  # the good text of the junk host goes with its host
    assert quality.keep_documents(docs).columns == docs.columns


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, source string")
    assert quality.keep_documents(docs).count() == 0
