from __future__ import annotations

import random
import re
import tracemalloc

import duckdb
import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from speechlake.functions import arrays, warp
from speechlake.operators import alignment, batches, evaluation, intervals, sequences
from speechlake.plans import REGISTRY, alignments

LENGTHS = "utt int, silent boolean, speech_len int, phone_len int, emg_len int, video_len int, voiced_len int"


def targets(spark, row, fr=100.0):
    made = sequences.alignment_targets(spark.createDataFrame([row], LENGTHS), fr).first()
    return made.speech_to, made.phone_to, made.emg_to, made.voiced_to, made.video_to


def test_alignment_of_a_voiced_recording(spark):
    assert targets(spark, (1, False, 103, 102, 420, 30, None)) == (100, 100, 400, None, 25)
    assert targets(spark, (1, False, 103, 102, 420, 10, None)) == (40, 40, 160, None, 10)
    assert targets(spark, (1, False, 103, 102, 421, 0, None)) == (102, 102, 408, None, 0)


def test_alignment_of_a_silent_recording(spark):
    assert targets(spark, (1, True, 103, 102, 420, 20, 300)) == (75, 75, 320, 300, 20)
    assert targets(spark, (1, True, 103, 102, 420, 0, None)) == (0, 0, 420, 0, 0)


def test_alignment_at_a_fractional_rate(spark):
    speech, _, emg, _, video = targets(spark, (1, False, 100, 100, 400, 20, None), 86.13)
    assert (speech, emg, video) == (68, 272, 19)


@pytest.mark.parametrize("seed", range(3))
def test_aligned_lengths_keep_their_ratio(spark, seed):
    rnd = random.Random(seed)
    rows = [
        (i, rnd.random() < 0.5, *(rnd.randint(1, 200) for _ in range(2)), rnd.randint(1, 800), rnd.randint(1, 60), rnd.randint(1, 800))
        for i in range(100)
    ]
    for r in sequences.alignment_targets(spark.createDataFrame(rows, LENGTHS), 100.0).collect():
        assert r.emg_to == 4 * 4 * r.video_to and r.emg_to <= r.emg_len and r.video_to <= r.video_len
        assert r.speech_to == r.phone_to <= r.speech_len
        assert (r.voiced_to == 4 * r.speech_to) if r.silent else (r.emg_to == 4 * r.speech_to)


def test_edge_steps_stay_in_step():
    assert sequences.edge_steps(100.0) == {"speech": 20, "emg": 80, "video": 5}
    assert sequences.edge_steps(86.13) == {"speech": 17, "emg": 68, "video": 5}


def test_trims(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(10)] + [(2, t, float(t)) for t in range(4)], "utt int, t int, value double")
    made = {(r.utt, r.t): r.value for r in sequences.trim_edges(df, ["utt"], 2, 3).collect()}
    assert made == {(1, t): float(t + 2) for t in range(5)}
    want = spark.createDataFrame([(1, 7), (2, 9)], "utt int, want int")
    made = {(r.utt, r.t): r.value for r in sequences.center_trim(df, ["utt"], want, "want").collect()}
    assert made == {(1, t): float(t + 1) for t in range(7)} | {(2, t): float(t) for t in range(4)}


def test_array_forms(spark):
    row = spark.createDataFrame([([1, 2, 3, 4, 5],)], "x array<int>").select(
        arrays.trim_edges(F.col("x"), 1, 2).alias("a"),
        arrays.trim_edges(F.col("x"), 3).alias("b"),
        arrays.center_trim(F.col("x"), F.lit(2)).alias("c"),
        arrays.pad_to(F.col("x"), F.lit(7), F.lit(0)).alias("d"),
        arrays.padding_mask(F.lit(2), F.lit(3)).alias("e"),
        arrays.padding_mask(F.lit(0), F.lit(0)).alias("f"),
        arrays.pick_channels(F.col("x"), [4, 0]).alias("g"),
    ).first()
    assert row.a == [2, 3] and row.b == [] and row.c == [2, 3] and row.d == [1, 2, 3, 4, 5, 0, 0]
    assert row.e == [False, False, True] and row.f == [] and row.g == [5, 1]
    with pytest.raises(Exception, match="expected one matrix"):
        spark.range(1).select(arrays.drop_unit_axis(F.array(F.array(F.lit(1)), F.array(F.lit(2))))).collect()


def test_splice(spark):
    rnd = np.random.default_rng(1)
    chunks = [rnd.normal(size=n) for n in (9, 6, 12)]
    rows = [(1, s, i, float(v)) for s, c in enumerate(chunks) for i, v in enumerate(c)]
    df = spark.createDataFrame(rows, "utt int, seg int, i int, value double")
    want, at = np.zeros(27 - 2 * 4), 0
    for c in chunks:
        c = c.copy()
        c[:4] *= np.linspace(0, 1, 4)
        c[-4:] *= np.linspace(1, 0, 4)
        want[at : at + len(c)] += c
        at += len(c) - 4
    for hot_rows in (1, 1 << 20):
        made = [r.value for r in sequences.splice(df, ["utt"], 4, hot_rows).orderBy("t").collect()]
        assert np.allclose(made, want)
    with pytest.raises(Exception, match="shorter than the overlap"):
        sequences.splice(df, ["utt"], 7).collect()


def test_fixed_length(spark):
    df = spark.createDataFrame([(u, t, float(10 * u + t)) for u in (1, 2) for t in range(5)], "utt int, t int, value double")
    made = sorted((r.piece, r.pos, r.value) for r in sequences.fixed_length_chunks(df, "utt", 4).collect())
    flat = [10, 11, 12, 13, 14, 20, 21, 22, 23, 24, 0, 0]
    assert made == [(i // 4, i % 4, float(v)) for i, v in enumerate(flat)]


def test_random_changes_are_reproducible_and_complete(spark):
    df = spark.createDataFrame([(1, c, t, float(t + 1)) for c in (0, 1) for t in range(30)], "utt int, ch int, t int, value double")
    a = sequences.permute_channels(df, ["utt", "ch"], [1], 7).orderBy("ch", "t").collect()
    b = sequences.permute_channels(df.repartition(3), ["utt", "ch"], [1], 7, hot_rows=4).orderBy("ch", "t").collect()
    assert a == b
    assert [r.value for r in a[:30]] == [t + 1.0 for t in range(30)] != [r.value for r in a[30:]]
    assert sorted(r.value for r in a[30:]) == [t + 1.0 for t in range(30)]
    short = {r.t: r.value for r in sequences.random_segment(df.where("ch = 0"), ["utt"], 40, 1).collect()}
    assert short == {t: t + 1.0 if t < 30 else 0.0 for t in range(40)}


def test_batch_caps(spark):
    rows = [(1, 0, 900, 3700, 0), (2, 0, 300, 1200, 60), (3, 1, 10, 40, 0)]
    df = spark.createDataFrame(rows, "utt int, batch int, speech_len int, emg_len int, video_len int")
    made = {r.utt: r for r in batches.cap_lengths(df, 100.0).collect()}
    assert (made[1].max_target, made[1].max_est, made[1].max_video) == (800, 800, 60)
    assert (made[1].target_length, made[1].est_length, made[1].video_length) == (800, 800, 0)
    assert (made[2].target_length, made[2].est_length, made[2].video_length, made[2].video_est_length) == (300, 300, 60, 240)
    assert (made[3].max_video, made[3].target_length, made[3].est_length) == (0, 10, 10)
    assert [r.slot for r in batches.sort_in_batch(df, "utt").orderBy("utt").collect()] == [0, 1, 0]


# Warping ------------------------------------------------------------------------


def brute_warp(c):
    n, m = c.shape
    d = np.full((n, m), np.inf)
    d[0, 0] = 0
    for i in range(1, n):
        for j in range(1, m):
            d[i, j] = c[i, j] + min(d[i - 1, j], d[i, j - 1], d[i - 1, j - 1])
    i, j, found = n - 1, m - 1, [0] * n
    while i > 0 and j > 0:
        found[i] = j
        options = [(i - 1, j), (i, j - 1), (i - 1, j - 1)]
        i, j = min(options, key=lambda p: d[p])
    return d[-1, -1], found


@pytest.mark.parametrize("cells", [1, 500, 1 << 22])
def test_warp_equals_the_recursion(spark, monkeypatch, cells):
    monkeypatch.setattr(warp, "CELLS", cells)
    rnd = np.random.default_rng(2)
    shapes = [(1, 1), (1, 5), (5, 1), (2, 2)] + [tuple(rnd.integers(1, 20, 2)) for _ in range(60)]
    matrices = [rnd.integers(0, 4, s).astype(float) for s in shapes]
    for at, cost, found in warp._solve([m.shape for m in matrices], lambda at: lambda i, j: matrices[at][i, j]):
        want, path = brute_warp(matrices[at])
        assert cost == want and found.tolist() == path
        assert all(a <= b for a, b in zip(found, found[1:]))


def test_long_warp_equals_the_recursion():
    rnd = np.random.default_rng(6)
    for shape in [(1, 1), (1, 7), (7, 1), (2, 2), (3, 90), (90, 3), (41, 57)]:
        costs = rnd.integers(0, 3, shape).astype(float)  # many ties
        end, found = warp.long_warp(*shape, lambda i, j: costs[i, j])
        want, path = brute_warp(costs)
        assert end == want and found.tolist() == path
    y, p = rnd.integers(0, 5, (800, 2)).astype(float), rnd.integers(0, 5, (700, 2)).astype(float)
    cells = warp._distance(y, p)
    whole = cells(np.arange(800)[:, None], np.arange(700)[None, :])
    total = warp.warp(whole[None])
    end, found = warp.long_warp(800, 700, cells)
    assert end == total[0, -1, -1] and (found == warp.backtrack(total, np.array([800]), np.array([700]))[0]).all()


def test_warp_of_long_sequences_in_little_memory():
    n = 6000  # a matrix of 288 MB
    step = np.sort(np.random.default_rng(1).random((n, 1)), axis=0)
    tracemalloc.start()
    end, found = warp.long_warp(n, n, warp._distance(step, step))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert end == 0 and found.tolist() == list(range(n)) and peak < 60e6


def test_empty_sequences_have_no_cost(spark):
    rows = [(1, [[1.0]], [[2.0], [5.0]]), (2, [], [[1.0]]), (3, None, [[1.0]]), (4, [[1.0]], [])]
    df = spark.createDataFrame(rows, "i int, a array<array<double>>, b array<array<double>>").coalesce(1)
    made = {r.i: (r.c, r.m, r.d) for r in df.select("i", warp.warp_cost("a", "b").alias("c"), warp.align_rows("a", "b").alias("m"), warp.distance_profile("a", "b").alias("d")).collect()}
    assert made[1] == (float("inf"), [0], ([1.0], [5.0]))
    assert [made[k][:2] for k in (2, 3, 4)] == [(None, []), (None, None), (None, [0])]
    assert made[2][2] == ([], []) and np.isnan(made[4][2].nearest).all()


def test_warping_runs_once_in_a_plan(spark):
    for query in (alignments.align_rows, alignments.pair_scores, alignments.sequence_losses, alignments.aligned_accuracy, alignments.alignment_gather):
        plan = query(spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        assert len(re.findall("ArrowEvalPython", plan)) == 1, query.__name__


def test_warp_columns(spark):
    rnd = np.random.default_rng(3)
    rows = [(i, rnd.random((4 + i, 6)).tolist()) for i in range(5)]
    df = spark.createDataFrame(rows, "i int, c array<array<double>>")
    for r in df.select("c", warp.matrix_cost("c").alias("d"), warp.matrix_alignment("c").alias("a")).collect():
        want, path = brute_warp(np.array(r.c))
        assert abs(r.d - want) < 1e-12 and r.a == path


def test_noise_targets_cost_nothing_and_do_not_count(spark):
    row = (1, True, [[0.0], [5.0]], [[9.0, 0.0], [0.0, 9.0]], [[0.0], [5.0], [5.0]], [0, 1, 0])
    schema = "utt int, silent boolean, feat array<array<double>>, scores array<array<double>>, y array<array<double>>, phones array<int>"
    aligned = alignment.align_pairs(spark.createDataFrame([row], schema), 0.5, noise=0)
    frames = alignment.aligned_frames(aligned, ["utt"], 0).orderBy("t").collect()
    assert [r.pred_t for r in frames] == [0, 1, 1] and [r.valid for r in frames] == [False, True, False]
    df = alignment.aligned_frames(aligned, ["utt"], 0)
    assert evaluation.masked_accuracy(df, "pred", "target", 0).first().accuracy == 1.0
    nothing = df.withColumn("valid", F.lit(False))
    assert evaluation.sequence_losses(nothing, 0.5, 1, noise_known=True).first().loss_ph == 0.0
    uneven = spark.createDataFrame([(1, False, *row[2:])], schema)
    with pytest.raises(Exception, match="differ in length"):
        alignment.align_pairs(uneven, 0.5, 0).collect()


# Intervals ----------------------------------------------------------------------

INTERVALS = "utt int, tier string, idx int, xmin double, xmax double, label string"


def test_frames_of_intervals(spark):
    rows = [
        (1, "phones", 0, 0.0, 0.3, "a"), (1, "phones", 1, 0.2, 0.5, "b"), (1, "phones", 2, 0.7, 0.9, "c"),
        (1, "words", 0, 0.0, 9.0, "x"), (2, "phones", 0, 0.0, 0.05, "a"),
    ]
    df = spark.createDataFrame(rows, INTERVALS)
    labels = lambda d: [r.label for r in d.where("utt = 1").orderBy("frame").collect()]
    made = intervals.frame_labels(df, "phones", 10.0)
    assert labels(made) == ["a", "a", "b", "b", "b", "sil", "sil", "c", "c", "sil"]
    wanted = spark.createDataFrame([(1, 12), (2, 1)], "utt int, n int")
    assert labels(intervals.frame_labels(df, "phones", 10.0, wanted)) == labels(made) + ["sil"] * 2
    short = spark.createDataFrame([(1, 3), (2, 0)], "utt int, n int")
    made = intervals.frame_labels(df, "phones", 10.0, short)
    assert labels(made) == ["a", "a", "b"] and made.count() == 3


def test_user_function_sees_whole_channels(spark):
    sizes = {(None, 0): 3, (0, 0): 12_000, (0, 1): 1, (1, None): 2, (1, 1): 20_001, **{(u, 0): 1 for u in range(2, 3000)}}
    rows = [(u, c, i) for (u, c), n in sizes.items() for i in range(n)]
    df = spark.createDataFrame(pd.DataFrame({"utt": pd.array([r[0] for r in rows], "Int64"), "ch": pd.array([r[1] for r in rows], "Int64"), "t": [r[2] for r in rows]}), "utt long, ch long, t long")
    calls = spark.sparkContext.accumulator(0)

    def count(pdf):
        calls.add(1)
        assert pdf.utt.nunique(dropna=False) == pdf.ch.nunique(dropna=False) == 1 and list(pdf.index) == list(range(len(pdf)))
        return pdf.head(1).assign(n=len(pdf), total=pdf.t.sum())[["utt", "ch", "n", "total"]] if len(pdf) != 2 else pdf.head(0)

    made = alignment.apply_per_channel(df, count, ["utt"], "utt long, ch long, n long, total long")
    assert "FlatMapGroupsInPandas" not in made._jdf.queryExecution().executedPlan().toString()
    got = {(r.utt, r.ch): (r.n, r.total) for r in made.collect()}
    assert got == {k: (n, n * (n - 1) // 2) for k, n in sizes.items() if n != 2} and calls.value == len(sizes)


def test_frame_sorts_grow_in_number(spark, monkeypatch):
    monkeypatch.setattr(intervals, "FRAMES", 50)
    rows = [(u, "phones", i, i * 0.1, i * 0.1 + 0.3, "a") for u in range(20) for i in range(100)]
    made = intervals.frame_labels(spark.createDataFrame(rows, INTERVALS), "phones", 10.0)
    assert made.rdd.getNumPartitions() >= 40 and made.count() == 20 * 103


def test_files_of_five_digits_are_fixed(spark):
    rows = [(1, "tg_0001.TextGrid"), (2, "tg_10001.TextGrid"), (3, "tg_001.TextGrid"), (4, "tg_4294967296.TextGrid")]
    files = spark.createDataFrame(rows, "utt int, path string")
    noisy = files.select("utt", F.lit(True).alias("found"))
    made = intervals.reprocess_report(files, noisy, noisy.withColumn("found", F.lit(False))).collect()
    assert dict(tuple(r) for r in made) == {1: "fixed", 2: "fixed", 3: "failed", 4: "fixed"}


def test_grid_in_chunks(spark):
    sizes = spark.createDataFrame([(1, 25), (2, 0), (3, 8)], "utt int, n int")
    rows = intervals.frame_grid(sizes, ["utt"], "n", 8).groupBy("utt").agg(F.sort_array(F.collect_list("frame")).alias("f")).collect()
    assert {r.utt: r.f for r in rows} == {1: list(range(25)), 3: list(range(8))}


def test_last_interval(spark):
    last = {1: (1.0, 1.5, "a"), 2: (1.0, 1.5, ""), 3: (1.0, 1.1, "a"), 4: (1.0, 1.3, "a"), 5: (1.0, 1.5, "sp")}
    rows = [(u, "phones", 1, *v) for u, v in last.items()] + [(u, "phones", 0, 0.0, 1.0, "z") for u in last]
    rows += [(6, "words", 0, 0.0, 1.0, "z"), (7, "phones", None, 0.0, 1.0, None)]
    df = spark.createDataFrame(rows, INTERVALS)
    report = intervals.last_interval_report(df, silence=["", "sp"])
    reasons = {r.utt: r.reason for r in report.collect()}
    assert reasons == {
        1: "fixed_last:a, old_dur=0.500000, rem=0.200000", 2: "already_ends_with_silence", 3: "last_dur<0.3",
        4: "last_dur<=fixed_dur(0.3)", 5: "already_ends_with_silence", 6: "missing_tier:phones", 7: "empty_intervals",
    }
    fixed = intervals.repair_last_intervals(df, report).where("utt = 1").orderBy("idx").collect()
    assert [(r.idx, r.xmin, r.xmax, r.label) for r in fixed] == [(0, 0.0, 1.0, "z"), (1, 1.0, 1.3, "a"), (2, 1.3, 1.5, "")]


def test_a_long_utterance_is_cut_and_keeps_its_pairs(spark, tmp_path):
    sizes = {4: 30, 5: 805, 6: 20, 8: 900, 9: 5}
    rows = [(u, 1_600_000_000 + t, 1000 * u + t, float(t), '{"k": 1}', "click") for u, n in sizes.items() for t in range(n)]
    events = spark.createDataFrame(rows, "user_id long, ts long, event_id long, value double, props string, event_type string")
    events.withColumn("ts", F.timestamp_seconds("ts")).write.parquet(str(tmp_path / "events.parquet"))
    seqs = {r.utt: r.feat for r in alignments.sequences(spark, str(tmp_path)).collect()}
    assert {u: len(f) for u, f in seqs.items()} == {u: min(n, 800) for u, n in sizes.items()}
    assert [f[0] for f in seqs[5]] == [t / 100 for t in range(800)]
    pairs = {r.utt: (len(r.feat), len(r.y)) for r in alignments.pairs(spark, str(tmp_path)).collect()}
    assert pairs == {4: (30, 800), 5: (20, 20), 8: (800, 5)}
    made = {r.utt: r.frames for r in alignments.pair_extension(spark, str(tmp_path)).collect()}
    pandas_side = duckdb.connect().execute(
        f"CREATE VIEW events AS FROM '{tmp_path}/events.parquet/*.parquet'; " + REGISTRY["pair_extension_u2"].sql
    ).fetchall()
    assert dict(pandas_side) == made == {4: 800, 5: 20, 8: 5}
