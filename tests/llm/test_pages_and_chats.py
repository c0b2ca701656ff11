from __future__ import annotations

import re

from speechlake.llm import preferences, urls


def test_rules_and_parts(spark):
    cases = [None, "", "nourl", "http://A.com", "x://b.NET/es/1?q", "x://b.NET/es/1?q", "http://www.example.com/en/#a", "http://m.example.com/en/b", "http://notexample.com/en/", "a://b://c/d", "http://x.com/%0A?", "http://" + "a" * 3000 + ".org/x"]
    pages = spark.createDataFrame([(i, u, "mine") for i, u in enumerate(cases)], "page_id long, url string, rule string")
    words = spark.createDataFrame([("a", 3), ("the", 9)], "piece string, n long")
    got = {r.page_id: r for r in urls.judged(pages, words).collect()}
    assert len(got) == len(cases)
    for i, url in enumerate(cases):
        rest = (url or "").partition("://")[2]
        host = re.split("[/?#]", rest)[0]
        path = re.split("[?#]", rest[len(host) :])[0]
        host = host.lower()
        fits = [(len(h + p), v, h + p) for v, h, p in urls.RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        assert (got[i].host, got[i].path, got[i].rule) == (host, path, max(fits)[2] if fits else None)
        assert got[i].verdict == max(fits)[1] if fits else got[i].verdict in ("allow", "block")


def test_names_are_split_and_seeds_learnt(spark):
    words = spark.createDataFrame([("cheap", 50), ("pills", 40), ("news", 60), ("daily", 50), ("a", 500)], "piece string, n long")
    labels = spark.createDataFrame([("cheappills",), ("dailynews",), ("zq",)], "label string")
    assert {r.label: r.words for r in urls.segmented(labels, words).collect()} == {"cheappills": ["cheap", "pills"], "dailynews": ["daily", "news"], "zq": ["zq"]}
    rows = [(f"http://cheappills{i}.org/buy",) for i in range(20)] + [(f"http://dailynews{i}.org/read",) for i in range(30)]
    got = urls.judged(spark.createDataFrame(rows, "url string"), words).collect()
    assert all((r.verdict == "block") == ("pills" in r.url) for r in got)
    assert urls.judged(spark.createDataFrame([], "url string"), words).count() == 0


def test_common_prefix_and_masks(spark):
    turns = [
        (1, 0, "user", "hi"), (1, 1, "assistant", "hello"), (1, 2, "user", "more"), (1, 3, "assistant", "fine"),
        (2, 0, "user", "hi"), (2, 1, "assistant", "go away"),
        (3, None, None, None), (4, 0, "user", "hi"), (4, 1, "assistant", "hello"), (4, 1, "assistant", "hello"),
    ]
    table = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS turns")
    convs = preferences.conversations(table)
    made = preferences.formatted(preferences.stale_pairs(convs).union(preferences.opening_pairs(convs))).collect()
    by = {(r.chosen_id, r.rejected_id, r.kind): r for r in made}
    assert set(by) == {(1, 1, "stale"), (4, 4, "stale"), (1, 2, "opening"), (1, 4, "opening")}
    assert by[1, 1, "stale"].n_common == 3 and by[1, 2, "opening"].n_common == 1 and by[1, 4, "opening"].n_common == 2
    for r in made:
        for text, spans in ((r.chosen_text, r.chosen_spans), (r.rejected_text, r.rejected_spans)):
            assert re.findall(r"(?<=assistant\n)[^<]*<\|im_end\|>", text) == [text[s.start : s.end] for s in spans]
    assert preferences.formatted(preferences.stale_pairs(preferences.conversations(table.where("false")))).count() == 0
