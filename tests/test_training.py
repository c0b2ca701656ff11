from __future__ import annotations

import random

from pyspark.sql import functions as F

from speechlake.operators import training

RATE, STEPS, FPS, EDGE = 4.0, 4, 1.0, 0.3  # four frames a picture, one frame off at each edge
CAPS = {"speech": 8, "phone": 8, "emg": 32, "voiced": 32, "video": 2}
EDGES = {"speech": 1, "phone": 1, "emg": 4, "voiced": 4, "video": 0}
FILL = {"speech": [7.0, 8.0], "phone": [4.0], "emg": [0.0], "voiced": [0.0], "video": [0.5]}


def centre(x, n):
    n = max(n, 0)
    spare = max(len(x) - n, 0)
    return x[spare // 2 : len(x) - (spare - spare // 2)]


def brute_item(silent, parts):
    """One utterance, with lists instead of offsets."""
    video = len(parts["video"]) * 4 if parts["video"] else None
    whole = lambda n: n // 4 * 4 if video is not None else n
    least = lambda *n: min(x for x in n if x is not None)
    emg = len(parts["emg"]) // 4
    if silent:
        a, g = whole(least(emg, video)), least(len(parts["speech"]), len(parts["phone"]), len(parts["voiced"]) // 4)
    else:
        a = g = whole(least(len(parts["speech"]), len(parts["phone"]), emg, video))
    want = {"speech": g, "phone": g, "emg": 4 * a, "voiced": 4 * g if silent else 0, "video": a // 4 if video is not None else 0}
    cut = {m: centre(x, want[m]) if m != "voiced" or silent else [] for m, x in parts.items()}
    return {m: x[EDGES[m] : len(x) - EDGES[m]] if len(x) > 2 * EDGES[m] else [] for m, x in cut.items()}


def brute_batch(items):
    target = min(max(len(i["speech"]) for i in items.values()), 8)
    est = min(max(len(i["emg"]) // 4 for i in items.values()), 8)
    longest = max(len(i["video"]) for i in items.values())
    size = {"speech": target, "phone": target, "emg": est * 4, "voiced": est * 4, "video": min(longest, 8, -(-est // 4)) if longest else 0}
    return {
        (utt, m): [(x, False) for x in item[m][: size[m]]] + [(FILL[m], True)] * (size[m] - min(len(item[m]), size[m]))
        for utt, item in items.items()
        for m in training.MODALITIES
    }


def test_chain_equals_lists(spark):
    draw = random.Random(8)
    utterances, rows, items = [], [], {}
    for utt in range(40):
        silent = utt % 2 == 0
        n = draw.choice([0, 1, 5, 6, 9, 12, 20])
        sizes = {"speech": n, "phone": n + draw.choice([0, -1, 2]) if n else 0, "emg": 4 * n + draw.randrange(9), "video": draw.choice([0, n // 4, n // 4 + 2])}
        sizes["voiced"] = max(4 * n + draw.randrange(-6, 7), 0) if silent else 0
        parts = {m: [[float(1000 * utt + t)] * (2 if m == "speech" else 1) for t in range(sizes[m])] for m in training.MODALITIES}
        utterances.append((utt, silent))
        rows += [(utt, m, t, x) for m in parts for t, x in enumerate(parts[m])]
        items[utt] = brute_item(silent, parts)
    table = spark.createDataFrame(rows, "utt long, modality string, t int, x array<double>")
    known = spark.createDataFrame(utterances, "utt long, silent boolean")
    cut = training.windows(training.modality_lengths(table, known), RATE, EDGE, STEPS, FPS).cache()
    plan = training.batch_plan(cut, 7, 3, RATE, 0, 2.0, STEPS, FPS).cache()
    fillers = {m: F.array(*map(F.lit, x)) for m, x in FILL.items()}
    made = training.training_rows(table, plan, fillers).collect()
    batch = {r.utt: (r.batch, r.slot) for r in plan.collect()}
    want = {}
    for number in {b for b, _ in batch.values()}:
        members = {u: items[u] for u, (b, _) in batch.items() if b == number}
        want |= brute_batch(members)
        order = sorted(members, key=lambda u: batch[u][1])
        assert order == sorted(members, key=lambda u: (-len(items[u]["speech"]), u))
    got: dict = {}
    for r in made:
        assert (r.batch, r.slot) == batch[r.utt]
        got.setdefault((r.utt, r.modality), []).append((r.t, (r.x, r.padded)))
    for key, values in want.items():
        found = sorted(got.pop(key, []), key=lambda v: v[0])
        assert [t for t, _ in found] == list(range(len(values))), key
        assert [v for _, v in found] == values, key
    assert not got
