"""Results must not depend on whether a key is cut into buckets or chunks."""

from __future__ import annotations

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from speechlake.operators import manifest, ordering, sequences, signals, stats


@pytest.fixture(scope="module")
def skewed(spark):
    rnd = random.Random(3)
    rows = [("hot", t, rnd.random()) for t in range(500)]
    rows += [(f"k{k}", t, rnd.random()) for k in range(20) for t in range(rnd.randint(1, 8))]
    rnd.shuffle(rows)
    return spark.createDataFrame(rows, "key string, at int, v double").repartition(5)


@pytest.mark.parametrize("hot_rows", [7, 1 << 20])
def test_dense_index(skewed, hot_rows):
    made = ordering.dense_index(skewed, ["key"], [F.col("at")], F.col("at"), "t", hot_rows)
    assert made.where("t <> at").count() == 0 and made.count() == skewed.count()


@pytest.mark.parametrize("hot_rows", [7, 1 << 20])
def test_running_offset(skewed, hot_rows):
    made = ordering.running_offset(skewed, [], [F.col("key"), F.col("at")], F.col("at") * 0, F.col("at"), "off", hot_rows)
    rows = sorted((r.key, r["at"], r.off) for r in made.collect())
    total = 0
    for _, at, off in rows:
        assert off == total
        total += at


def test_an_outlier_does_not_fill_one_bucket(spark):
    df = spark.range(100_000).select(F.lit("k").alias("key"), F.when(F.col("id") == 7, 10**15).otherwise(F.col("id")).alias("at"))
    hot = ordering._hot_keys(df, ["key"], F.col("at"), 1000)
    sizes = [r["count"] for r in ordering._bucketed(df, ["key"], F.col("at"), hot).groupBy("_bucket").count().collect()]
    assert len(sizes) > 80 and max(sizes) < 2500


def test_split_is_the_same_with_hot_sessions(spark):
    keys = spark.createDataFrame([("s1", n) for n in range(200)] + [("s2", n) for n in range(3)] + [("s3", 1)], "session string, data_num int")
    plain = manifest.assign_splits(keys, (0.85, 0.075, 0.075))
    cut = manifest.assign_splits(keys, (0.85, 0.075, 0.075), hot_rows=10)
    assert plain.exceptAll(cut).count() == 0
    counts = {(r.session, r.split): r["count"] for r in plain.groupBy("session", "split").count().collect()}
    assert counts == {("s1", "train"): 170, ("s1", "valid"): 15, ("s1", "test"): 15, ("s2", "train"): 3, ("s3", "train"): 1}


def test_split_overflow_is_taken_from_valid(spark):
    keys = spark.createDataFrame([("s", n) for n in range(3)], "session string, data_num int")
    counts = {r.split: r["count"] for r in manifest.assign_splits(keys, (0.5, 0.5, 0.0)).groupBy("split").count().collect()}
    assert counts == {"train": 2, "valid": 1}
    with pytest.raises(ValueError):
        manifest.assign_splits(keys, (0.5, 0.1, 0.1))


def test_median(spark):
    for values in ([1.0], [1.0, 2.0], [5.0, 1.0, 3.0], [2.0] * 50 + [9.0] * 49, [float(v) for v in range(101)]):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        for hot_rows in (3, 1 << 20):
            assert stats.median(df, "v", hot_rows).first()[0] == np.median(values)


def test_histogram_of_a_constant_and_floor(spark):
    df = spark.createDataFrame([(2.0,)] * 4, "v double")
    rows = {r.bin: r.n for r in stats.histogram(df, "v", 10).collect()}
    assert sum(rows.values()) == 4 and rows[6] == 4 and len(rows) == 10
    vectors = spark.createDataFrame([([1.0, 2.0],), ([1.0, 4.0],)], "x array<double>")
    made = {r.dim: (r.n, r.mean, r.m2, r["std"]) for r in stats.dim_moments(vectors, "x").collect()}
    assert made == {0: (2, 1.0, 0.0, 1e-8), 1: (2, 3.0, 2.0, 1.0)}


@pytest.fixture(scope="module")
def waves(spark):
    rnd = np.random.default_rng(4)
    rows = [(u, 0, t, float(rnd.normal())) for u, n in ((1, 300), (2, 15), (3, 16), (4, 22)) for t in range(n)]
    return spark.createDataFrame(rows, "utt int, ch int, t int, value double").repartition(4)


def same(a, b, keys, tol=1e-9):
    left = {tuple(r[k] for k in keys): r for r in a.collect()}
    right = {tuple(r[k] for k in keys): r for r in b.collect()}
    assert left.keys() == right.keys() and left
    for key, r in left.items():
        for c in a.columns:
            if c not in keys:
                assert np.allclose(r[c], right[key][c], atol=tol), (key, c)


def test_chunked_windows(waves):
    keys = ["utt", "ch"]
    same(signals.double_average(waves, keys, 32), signals.double_average(waves, keys), [*keys, "t"])
    same(signals.frame_features(waves, keys, 32), signals.frame_features(waves, keys), [*keys, "frame"])
    frames = {(r.utt): r["count"] for r in signals.frames(waves, keys).where("pos = 0").groupBy("utt").count().collect()}
    assert frames == {1: 48, 3: 1, 4: 2}


def test_gaps_longer_than_a_chunk(spark):
    rows = [(1, t, float(t) if t in (3, 90) else None) for t in range(100)] + [(2, t, None) for t in range(5)] + [(3, 0, 7.0)]
    df = spark.createDataFrame(rows, "utt int, t int, value double")
    made = {(r.utt, r.t): r.value for r in sequences.fill_gaps(df, ["utt"], size=8).collect()}
    assert {u for u, _ in made} == {1, 3}
    assert all(abs(made[1, t] - min(max(t, 3), 90)) < 1e-9 for t in range(100))


def test_smoothing_in_chunks(spark):
    rnd = random.Random(5)
    rows = [(1, t, p, rnd.random(), rnd.random()) for t in range(40) for p in range(4)]
    df = spark.createDataFrame(rows, "utt int, t int, point int, x double, y double")
    same(sequences.smooth_landmarks(df, ["utt"], size=8), sequences.smooth_landmarks(df, ["utt"]), ["utt", "t", "point"])


@pytest.mark.parametrize("size,hot_rows", [(4, 2), (1 << 16, 1 << 20)])
def test_pieces(spark, size, hot_rows):
    flat = spark.createDataFrame([(p, float(p)) for p in range(50)], "at long, value double")
    lengths = [3, 0, 20, 1, 1, 15]
    items = spark.createDataFrame(list(enumerate(lengths)), "item int, length long")
    made = sorted((r.item, r.t, r.value) for r in sequences.split_by_lengths(flat, items, "item", size, hot_rows).collect())
    want, at = [], 0
    for item, n in enumerate(lengths):
        want += [(item, t, float(at + t)) for t in range(n)]
        at += n
    assert made == want
    too_long = spark.createDataFrame([(1, 51)], "item int, length long")
    with pytest.raises(Exception, match="lengths exceed"):
        sequences.split_by_lengths(flat, too_long, "item", size, hot_rows).collect()
