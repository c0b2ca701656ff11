from __future__ import annotations

import random
import re

import numpy as np
import xxhash
from conftest import prose

from speechlake.llm import simhash
from speechlake.llm.components import components


def brute(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")) if w]
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64(g.encode(), seed=42).intdigest() for g in grams]
    return sum(1 << j for j in range(64) if 2 * sum(h >> j & 1 for h in hashes) > len(hashes))


def test_fingerprint_is_a_majority():
    for text in (None, "", " \n", "One", "one two", "ONE two three", "É a b c d", prose(3, 500)):
        assert simhash.fingerprint_of(text) == brute(text)


def test_planes_find_all_within_the_radius():
    rng = random.Random(5)
    values = [rng.getrandbits(64) for _ in range(150)]
    values += [v ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) for v in values[:60]]
    array = np.array(values, np.uint64).view(np.int64)
    planes = simhash.planes_of(array)
    for radius in (0, 1, 2, 3, 5):
        for value in values[::7]:
            near = simhash.within(value, planes, (1 << len(values)) - 1, radius)
            assert near == sum(1 << i for i, v in enumerate(values) if (v ^ value).bit_count() <= radius)


def _classes(values, radius):
    left, out = set(values), {}
    while left:
        todo = [min(left)]
        group = set()
        while todo:
            v = todo.pop()
            if v in left:
                left.discard(v)
                group.add(v)
                todo += [x for x in left if ((x ^ v) & (2**64 - 1)).bit_count() <= radius]
        out.update(dict.fromkeys(group, frozenset(group)))
    return out


def test_links_connect_what_brute_force_connects(spark):
    rng = random.Random(11)
    values = {rng.getrandbits(64) for _ in range(50)}
    chain = rng.getrandbits(64)
    for _ in range(300):  # a long chain of near prints fills few keys
        chain ^= 1 << rng.randrange(64)
        values.add(chain)
    signed = [v - 2**64 if v >> 63 else v for v in values]
    prints = spark.createDataFrame([(v,) for v in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(prints)).collect()}
    want = _classes(signed, simhash.RADIUS)
    for v in signed:
        assert roots.get(v, v) == min(want[v])


def test_rows_and_classes(documents):
    a = prose(1, 300)
    rows = [(7, a), (3, a.upper()), (3, a.upper()), (9, prose(2, 80)), (5, None), (4, ""), (None, " "), (None, "alone")]
    got = sorted((str(r.doc_id), str(r.component_id)) for r in simhash.classes(documents(rows)).collect())
    assert got == sorted([("7", "3"), ("3", "3"), ("3", "3"), ("9", "9"), ("5", "4"), ("4", "4"), ("None", "4"), ("None", "None")])
    kept = simhash.keep_one(documents(rows))
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["3", "4", "9", "None"]
    assert kept.columns == documents(rows).columns
    assert simhash.classes(documents([])).count() == 0


def test_components_of_a_star_and_a_path(spark):
    edges = [(0, i) for i in range(1, 200)] + [(1000 + i, 1001 + i) for i in range(100)] + [(5, 5), (0, 3)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(200)}, **{1000 + i: 1000 for i in range(101)}}


def test_a_class_of_equal_ids_keeps_one_row(documents):
    words = prose(1, 400).split()
    texts, seen = [], set()
    for i in range(400):  # one word less each, until two fingerprints are near
        text = " ".join(words[: 400 - i])
        fp = simhash.fingerprint_of(text)
        if texts and fp not in seen and any((fp ^ x).bit_count() <= simhash.RADIUS for x in seen):
            texts.append(text)
            break
        texts, seen = [text], {fp}
    if len(texts) < 2:
        raise AssertionError("no near texts")
    other = prose(9, 90)
    for one in (7, None):
        rows = [(one, t) for t in texts] + [(one, other)]
        kept = sorted(r.text for r in simhash.keep_one(documents(rows)).collect())
        assert len(kept) == 2 and other in kept
