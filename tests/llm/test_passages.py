from __future__ import annotations

import time

import numpy as np
import pyarrow as pa
import pytest
from conftest import prose

from speechlake.llm import passages


def test_compact_windows_are_the_tree_of_minima():
    rng = np.random.default_rng(1)
    hashes = np.concatenate([[0], rng.integers(1, 2**63, 400), [0], rng.integers(1, 40, 300), [0], [5] * 60, [0]]).astype(np.uint64)
    want = set()
    for c in range(len(hashes)):
        left, right = c, c
        while left > 0 and hashes[left - 1] > hashes[c]:
            left -= 1
        while right + 1 < len(hashes) and hashes[right + 1] >= hashes[c]:
            right += 1
        if hashes[c] and right - left + 1 >= passages.TOKENS:
            want.add((left, c, right))
    assert set(zip(*(x.tolist() for x in passages.compact_windows(hashes)))) == want


def test_repeats_link_documents(documents):
    shared, other = prose(40, 60), prose(41, 55)
    edited = " ".join("edit" if i == 25 else w for i, w in enumerate(prose(42, 120).split()))
    rows = [
        (1, f"{prose(1, 200)} {shared} {prose(2, 90)}"),
        (2, f"{prose(3, 90)} {shared.upper()} {prose(4, 300)}"),
        (3, f"{shared} {prose(5, 70)} {other}"),
        (4, f"{other} {prose(6, 70)}"),
        (5, prose(42, 120)),
        (6, edited),
        (7, prose(43, 80)),
        (8, prose(43, 80)),
        (9, "short copy"),
        (10, "short copy"),
        (11, None),
        (12, ""),
        (13, f"{prose(8, 100)} {' '.join(shared.split()[:30])} {prose(9, 100)}"),
    ]
    got = {r.doc_id: r for r in passages.repeats(documents(rows)).collect()}
    assert {d: r.component_id for d, r in got.items()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 7: 7, 8: 7, 9: 9, 10: 10, 11: 11, 12: 12, 13: 13}
    assert [tuple(s) for s in got[1].spans] == [(200, 260)] and [tuple(s) for s in got[8].spans] == [(0, 80)]
    assert got[13].n_links == 0 and got[9].n_links == 0 and got[3].n_links >= 2
    assert passages.repeats(documents([])).count() == 0


def test_a_passage_of_many_documents_is_one_class(documents):
    shared = prose(77, 52)
    rows = [(i, f"{prose(200 + i, 60)} {shared} {prose(500 + i, 60)}") for i in range(60)]
    assert {r.component_id for r in passages.repeats(documents(rows)).collect()} == {0}


def test_one_edit_at_any_place_is_verified_as_brute_force_says():
    rng = np.random.default_rng(3)
    for size in range(50, 71, 4):
        for edit in range(size):
            a = rng.integers(1, 2**62, size)
            b = a.copy()
            b[edit] = 7
            junk = [rng.integers(1, 2**62, 12) for _ in range(4)]
            x, y = np.concatenate([junk[0], a, junk[1]]), np.concatenate([junk[2], b, junk[3]])
            sets = [passages.shingles(w) for w in (a, b)]
            common = len(np.intersect1d(*sets))
            assert common >= 0.8 * (2 * len(sets[0]) - common)
            found = list(passages.verified(x, y))
            assert len(found) == 1
            s, e, t, f = found[0]
            assert min(e - s, f - t) >= 50 and max(e - s, f - t) <= size


def test_too_few_shared_words_are_no_passage():
    rng = np.random.default_rng(4)
    for shared, want in ((44, 0), (45, 1), (60, 1)):
        a = rng.integers(1, 2**62, shared)
        x, y = (np.concatenate([rng.integers(1, 2**62, 40), a, rng.integers(1, 2**62, 40)]) for _ in range(2))
        assert len(list(passages.verified(x, y))) == want


def test_texts_that_share_no_passage_with_the_first_of_a_key_meet(documents, spark):
    """Many texts quote 40 words of a passage; two hold all of it."""
    whole = prose(900, 54).split()
    quote = " ".join(whole[7:47])
    rows = [(i, f"{prose(1000 + i, 70)} {quote} {prose(2000 + i, 70)}") for i in range(30)]
    rows += [(100 + i, f"{prose(3000 + i, 70)} {' '.join(whole)} {prose(4000 + i, 70)}") for i in range(2)]
    got = {r.doc_id: r for r in passages.repeats(documents(rows)).collect()}
    assert {d for d, r in got.items() if r.component_id != d} == {101} and got[101].component_id == 100
    assert [tuple(s) for s in got[100].spans] == [(70, 124)]
    assert all(not got[i].spans for i in range(30))


def test_similar_passages_share_one_of_the_rarest_tokens():
    rng = np.random.default_rng(5)
    met = 0
    for _ in range(150):
        size = int(rng.integers(50, 95))
        a = rng.integers(1, 2**62, size)
        b = a.copy()
        for _ in range(int(rng.integers(0, 3))):
            b[rng.integers(size)] = rng.integers(1, 2**62)
        x, y = (np.concatenate([rng.integers(1, 2**62, 45 - (95 - size) // 3), w, rng.integers(1, 2**62, 60)]) for w in (a, b))
        sides = [passages.shingles(w) for w in (x, y)]
        at = [int(i) for i in range(len(sides[0])) if sides[0][i] in sides[1]]
        if not at:
            continue
        i = at[len(at) // 2]
        j = int(np.flatnonzero(sides[1] == sides[0][i])[0])
        # Any order common to both will do, here one that says nothing.
        chosen = []
        for tokens, place in zip(sides, (i, j)):
            ranks = np.argsort(np.argsort(tokens * np.uint64(0x9E3779B97F4A7C15)))
            where, token = passages.rarest(tokens, ranks, np.array([place]))
            assert set(where.tolist()) <= {0}
            chosen.append(set(tokens[token].tolist()))
        near = [w[max(p - passages.REACH, 0) : p + passages.REACH + passages.SHINGLE] for w, p in zip((x, y), (i, j))]
        spans = [(s + max(i - passages.REACH, 0), e + max(i - passages.REACH, 0)) for s, e, *_ in passages.verified(*near)]
        if any(s <= i and i + passages.SHINGLE <= e for s, e in spans):
            met += 1
            assert chosen[0] & chosen[1]
    assert met > 60


def test_places_near_an_end_and_repeated_tokens():
    few = np.arange(1, passages.TOKENS, dtype=np.uint64)
    assert not len(passages.rarest(few, np.arange(len(few)), np.array([0, 20]))[0])
    some = np.arange(1, passages.TOKENS + 1, dtype=np.uint64)
    assert set(passages.rarest(some, np.arange(len(some)), np.array([3]))[1].tolist()) <= set(range(9))
    periodic = np.tile(np.arange(1, 6, dtype=np.uint64), 30)
    where, token = passages.rarest(periodic, np.argsort(np.argsort(periodic, kind="stable")), np.array([70]))
    assert len(token) == 2 * passages.REACH + 1


@pytest.mark.parametrize("members", [passages.MEMBERS, 40])
def test_links_of_hot_lines_and_edited_passages_equal_brute_force(documents, monkeypatch, members):
    """Texts of lines that many share, a common quote, and passages with edits; keys
    of over 40 windows in rounds as well."""
    monkeypatch.setattr(passages, "MEMBERS", members)
    rng = np.random.default_rng(8)
    lines = [prose(6000 + k, 11) for k in range(12)]
    texts = [" ".join(lines[k] for k in rng.permutation(12)[:9]) for _ in range(40)]
    for k in range(40):
        words = prose(7000 + k, int(rng.integers(55, 100))).split()
        edited = list(words)
        for _ in range(int(rng.integers(0, 3))):
            edited[int(rng.integers(len(words)))] = "edit"
        for side, passage in ((0, words), (1, edited)):
            hot = lines[int(rng.integers(12))] + " " + lines[int(rng.integers(12))]
            texts.append(f"{prose(8000 + 2 * k + side, 60)} {hot} {' '.join(passage)} {hot} {prose(9000 + 2 * k + side, 60)}")
    words = [np.array([hash(w) for w in t.split()], np.int64) for t in texts]
    links = {(i, j) for i in range(len(texts)) for j in range(i) if next(passages.verified(words[i], words[j]), None)}

    def classes(pairs):
        root = list(range(len(texts)))
        for i, j in pairs:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
        return root

    want = classes(links)
    got = {r.doc_id: r.component_id for r in passages.repeats(documents(list(enumerate(texts)))).collect()}
    linked = [i for i in range(len(texts)) if want.count(want[i]) > 1]
    right = [i for i in linked if got[i] == want[i]]
    assert len(linked) > 60 and len(right) >= 0.9 * len(linked), (len(right), len(linked))
    assert all(want[i] == want[got[i]] for i in range(len(texts)))  # no false link


def _windows_of_a_key(rng, n):
    """Sketches that share a line in their middle; some share more."""
    line = rng.integers(1, 1 << 16, 12)
    stock = [rng.integers(1, 1 << 16, 60) for _ in range(6)]
    near = np.zeros((n, 2 * passages.REACH + 1), np.uint16)
    for k in range(n):
        row = rng.integers(1, 1 << 16, near.shape[1])
        if rng.random() < 0.6:  # a stretch of a stock text, with or without edits
            size, start = int(rng.integers(30, 60)), int(rng.integers(0, 5))
            row[40 : 40 + min(size, 51)] = stock[int(rng.integers(6))][start : start + size][: near.shape[1] - 40]
            row[rng.integers(0, near.shape[1], int(rng.integers(0, 5)))] = 7
        row[40:52] = line
        if rng.random() < 0.1:
            row[60:] = 0
        near[k] = row
    near[5] = near[2]
    return near


def test_windows_of_one_key_are_compared_with_all_that_stand_for_themselves():
    rng = np.random.default_rng(6)
    for _ in range(8):
        near = _windows_of_a_key(rng, 60)
        text = rng.integers(0, 50, 60)
        found = dict(passages.linked(text, near))
        strip = [row[row > 0] for row in near]
        match = lambda k, x: next(passages._matching(strip[k], strip[x]), None) is not None
        stands = []
        for k in range(60):
            if k in found:
                assert found[k] < k and text[found[k]] != text[k] and match(k, found[k])
            else:
                same = [x for x in range(k) if (near[x] == near[k]).all()]
                assert not [x for x in stands if text[x] != text[k] and match(k, x)] or same
                stands.append(k)
        assert len(found) > 3


def test_no_class_of_a_key_is_torn():
    rng = np.random.default_rng(8)

    def classes(pairs):
        root = list(range(60))
        for i, j in pairs:
            a, b = sorted((root[i], root[j]))
            root = [a if r == b else r for r in root]
        return root

    for _ in range(6):
        near = _windows_of_a_key(rng, 60)
        strip = [row[row > 0] for row in near]
        pairs = [(k, x) for k in range(60) for x in range(k) if next(passages._matching(strip[k], strip[x]), None)]
        assert classes(passages.linked(np.arange(60), near)) == classes(pairs)


def test_a_chain_of_windows_is_one_class():
    tokens = np.random.default_rng(9).choice(np.arange(1, 1 << 16), 200, replace=False).astype(np.uint16)
    width = 2 * passages.REACH + 1
    near = np.stack([tokens[at : at + width] for at in (0, 30, 60, 90)])  # only neighbours share 46 tokens
    for order in ((0, 1, 2, 3), (1, 0, 2, 3), (0, 3, 1, 2), (3, 1, 2, 0)):
        found = list(passages.linked(np.arange(4), near[list(order)]))
        assert {tuple(sorted((order[k], order[x]))) for k, x in found} == {(0, 1), (1, 2), (2, 3)}


def test_keys_that_span_batches_stay_together():
    rng = np.random.default_rng(7)
    near = _windows_of_a_key(rng, 60)
    text, key = np.arange(60), np.repeat([1, 2, 3, 4], [10, 35, 5, 10])
    columns = [pa.array(key), pa.array(text), pa.array(np.arange(60, dtype=np.int32)), pa.array(text), pa.array([r.tobytes() for r in near], pa.binary())]
    whole = pa.RecordBatch.from_arrays(columns, ["key", "text", "at", "around", "near"])
    want = None
    for size in (60, 1, 7, 10, 45):
        parts = [whole.slice(i, size) for i in range(0, 60, size)]
        rows = sorted(tuple(r.values()) for b in passages._compared(iter(parts)) for r in b.to_pylist())
        want = want or rows
        assert rows == want and rows


def test_windows_that_one_token_fills_are_not_compared_pair_by_pair():
    """20,000 windows of 400 texts of repeated words; comparing each with all before it takes minutes."""
    rng = np.random.default_rng(10)
    width = 2 * passages.REACH + 1
    near = rng.integers(100, 1 << 16, (20_000, width)).astype(np.uint16)
    left, right = rng.integers(0, 20, (2, len(near)))
    place = np.arange(width)
    near[(place >= left[:, None]) & (place < width - right[:, None])] = 7
    text = np.sort(rng.integers(0, 400, len(near)))
    began = time.process_time()
    links = list(passages.linked(text, near))
    assert time.process_time() - began < 10
    assert all(text[k] != text[x] for k, x in links)
    reached, met = {0}, 0
    while len(reached) > met:
        met = len(reached)
        for k, x in links:
            if k in reached or x in reached:
                reached |= {k, x}
    assert met == len(near)


def test_rows_that_stay_out_of_a_comparison_have_no_link():
    rng = np.random.default_rng(11)
    near = _windows_of_a_key(rng, 60)
    near[40:, 20:70] = 9  # runs of one token
    key = np.repeat([1, 2, 3], [30, 10, 20])
    traits = passages._distinct(near)
    rows = passages._meeting(key, near, *traits)
    assert 0 < len(rows) < 60
    for k in (1, 2, 3):
        part = np.flatnonzero(key == k)
        for a, b in passages.linked(part, near[part]):
            assert {part[a], part[b]} <= set(rows.tolist())


def test_regions_of_a_pair_are_verified_together_and_lose_no_passage():
    rng = np.random.default_rng(12)
    first, second, third = (rng.integers(1, 2**62, n) for n in (80, 60, 70))
    junk = [rng.integers(1, 2**62, 40) for _ in range(8)]
    x = np.concatenate([junk[0], first, junk[1], second, junk[2], third, junk[3]])
    y = np.concatenate([junk[4], third, junk[5], first, junk[6], second, junk[7]])
    places = [(60, 170), (100, 210), (180, 290), (200, 310), (280, 60), (300, 80)]
    regions = [(max(a - 45, 0), a + 45, max(b - 45, 0), b + 45, a, b) for a, b in places]
    spans = passages._of_pair(x, y, regions)
    assert sorted(s[:2] for s in spans) == [(40, 120), (160, 220), (260, 330)]
    assert sorted(s[2:] for s in spans) == [(40, 110), (150, 230), (270, 330)]


def test_places_of_one_pair_are_one_row_to_verify(spark):
    around = (50 << 32) | 50
    rows = [(1, 2, 100 + 5 * k, around, 200 + 5 * k, around, k) for k in range(40)]
    (row,) = passages._star_regions(spark.createDataFrame(rows, passages._STAR)).collect()
    assert (row.a_first, row.a_last, row.b_first, row.b_last) == (50, 345, 150, 445) and len(row.regions) == 40


def test_first_rows_of_keys_meet_the_others_however_batches_are_cut():
    rng = np.random.default_rng(13)
    key = np.repeat([1, 2, 3, 4, 5], [10, 1, 2, 30, 7])
    text = rng.integers(0, 6, 50)
    text[:10], text[11:13] = 3, (1, 2)
    rows = sorted({(int(k), int(x), int(p)) for k, x, p in zip(key, text, rng.integers(0, 9, 50))})
    copies = sorted(rows + rows[::3])
    columns = [pa.array([r[0] for r in copies]), pa.array([r[1] for r in copies]), pa.array([r[2] for r in copies], pa.int32()), pa.array([(60 << 32) | 60] * len(copies))]
    whole = pa.RecordBatch.from_arrays([*columns, pa.nulls(len(copies), passages._FOUND)], ["key", "text", "at", "around", "found"])
    firsts = {k: next(r for r in rows if r[0] == k) for k, *_ in rows}
    rest = {k: [r for r in rows if r[0] == k and r != firsts[k]] for k in firsts}
    want = sorted((x, firsts[k][1], p - firsts[k][2]) for k in rest for _, x, p in rest[k] if x != firsts[k][1])
    goes = {k for k in rest if len({r[1] for r in rest[k]}) > 1 or (firsts[k] in rows[::3] and any(r[1] != firsts[k][1] for r in rest[k]))}
    want_left = sorted(r for r in rows if r[0] in goes)
    for size in (len(copies), 1, 2, 3, 7, 20):
        got = [r for i in range(0, len(copies), size) for r in [whole.slice(i, size)]]
        out = [r for b in passages._matches(iter(got)) for r in b.to_pylist()]
        assert sorted((r["a"], r["b"], -r["shift"]) for r in out if r["number"] is not None) == want
        assert sorted((r["key"], r["a"], r["at"]) for r in out if r["number"] is None) == want_left
    assert all(k != 1 for k, *_ in want_left)


@pytest.mark.parametrize("tasks, members", [(1, passages.MEMBERS), (60, passages.MEMBERS), (8, passages.MEMBERS), (8, 4)])
def test_a_text_between_two_others_joins_them(spark, monkeypatch, tasks, members):
    """Of three texts the second is near the first and the third, which are not near
    each other; a key's or a task's first text may be any of them."""
    monkeypatch.setattr(passages, "MEMBERS", members)
    rows = []
    for k in range(20):
        words = prose(20_000 + k, 60).split()
        for edits in range(3):
            edited = [f"edit{k}" if i in (20, 40)[:edits] else w for i, w in enumerate(words)]
            rows.append((3 * k + edits, f"{prose(30_000 + 3 * k + edits, 60)} {' '.join(edited)} {prose(40_000 + 3 * k + edits, 60)}"))
    sides = [np.array([hash(w) for w in t.split()], np.int64) for _, t in rows[:3]]
    assert [next(passages.verified(sides[i], sides[j]), None) is not None for i, j in ((0, 1), (1, 2), (0, 2))] == [True, True, False]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(tasks, "doc_id") if tasks > 1 else spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)
    got = {r.doc_id: r.component_id for r in passages.repeats(docs).collect()}
    assert {d for d, c in got.items() if c != d - d % 3} == set()


def test_windows_with_a_link_meet_those_without():
    rng = np.random.default_rng(14)
    line = [rng.integers(1, 1 << 16, 2 * passages.REACH + 1).astype(np.uint16) for _ in range(4)]
    near = np.stack([line[k % 4] for k in range(40)])
    near[:, 0] = np.arange(1, 41)
    text = np.arange(40)
    # Two groups of one line each, and the others alone.
    group = np.where(text % 4 < 2, text % 4, text + 10)
    links = list(passages.linked(text, near, group=group))
    assert all(k % 4 == x % 4 and k % 4 >= 2 for k, x in links) and len(links) == 18
    group = np.where((text % 4 == 0) & (text > 0), 0, text + 10)
    links = list(passages.linked(text, near, group=group))
    assert sum(0 in pair for pair in links) == 1 and len(links) == 28
    at = np.zeros(40, np.int32)
    name = text.astype(np.int64)
    mate = np.where((text > 1) & (text % 4 == 1), name[np.maximum(text - 4, 0)], 0)
    number = passages._grouped(np.ones(40, np.int64), name, at, mate)
    assert len(set(number[1::4].tolist())) == 1 and len(set(number.tolist())) == 31


def test_runs_of_one_token_have_few_windows_and_are_marked_whole(documents):
    hashes = np.array([0] + [5] * 500 + [0] + [7] * passages.TOKENS + [0], np.uint64)
    l, c, r = passages.compact_windows(hashes)
    keep = passages.thinned(hashes, c)
    assert keep.sum() < len(c) / 30 and {1, 500 - passages.REACH} <= set(c[keep].tolist())
    reached = np.zeros(len(hashes), bool)
    for k in c[keep]:
        reached[k : k + passages.TOKENS] = True
    assert reached[hashes > 0].all()
    rows = [(k, f"{prose(50_000 + k, 60)} {'word ' * n} {prose(60_000 + k, 60)}") for k, n in enumerate((900, 60, 300, 700, 120, 55))]
    for r in passages.repeats(documents(rows)).collect():
        n = (900, 60, 300, 700, 120, 55)[r.doc_id]
        marked = np.zeros(n + 120, bool)
        for s, e in r.spans:
            marked[s:e] = True
        assert r.component_id == 0 and marked[60 : 60 + n].all()


def test_shared_tokens_of_one_order_are_judged_as_the_verification_does():
    rng = np.random.default_rng(15)
    width, seen = 2 * passages.REACH + 1, [0, 0]
    for _ in range(1500):
        a = rng.choice(np.arange(1, 1 << 16), width, replace=False).astype(np.uint16)
        size, start, at = int(rng.integers(38, 80)), int(rng.integers(0, 11)), int(rng.integers(0, 11))
        b = rng.choice(np.setdiff1d(np.arange(1, 1 << 16), a), width, replace=False).astype(np.uint16)
        own = a[start : start + size].copy()
        for _ in range(int(rng.integers(0, 4))):
            own = np.delete(own, int(rng.integers(len(own)))) if rng.random() < 0.5 else np.insert(own, int(rng.integers(len(own))), b[0] + 0)
        own = own[np.sort(np.unique(own, return_index=True)[1])]
        b = np.concatenate([b[1 : 1 + at], own, b[1 + at :]])[:width]
        b = np.where(np.isin(np.arange(width), np.sort(np.unique(b, return_index=True)[1])), b, 0)
        a[: int(rng.integers(0, 3)) * 10] = 0
        b = np.concatenate([b[b > 0], np.zeros((b == 0).sum(), np.uint16)])
        if min((a > 0).sum(), (b > 0).sum()) < passages.TOKENS:
            continue
        place = np.array([np.flatnonzero(a == t)[0] if t and t in a else 0 for t in b])
        hit = np.isin(b, a) & (b > 0)
        rising, found = passages._rising(hit[None], place[None])
        assert rising[0]
        want = next(passages._matching(a[a > 0], b[b > 0]), None) is not None
        assert found[0] == want
        seen[want] += 1
    assert min(seen) > 100
