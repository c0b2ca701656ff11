from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from speechlake.sources import scratch
from speechlake.sources.scratch import scratch_path
from speechlake.streaming import moments, running


def test_merged_moments_equal_those_of_all_rows():
    draw = np.random.default_rng(4)
    x = draw.normal(1e6, 1, (500, 3))  # a large mean, where sums of squares lose digits
    valid = draw.random(x.shape) < 0.8
    valid[:, 2] = False
    for cuts in ([0, 500], [0, 1, 2, 499, 500], [0, *sorted(draw.integers(0, 500, 20)), 500]):
        state = None
        for a, b in zip(cuts, cuts[1:]):
            state = moments.merged(state, moments.moments(x[a:b], valid[a:b]))
        assert state[0].tolist() == valid.sum(axis=0).tolist() and state[0][2] == 0
        for d in (0, 1):
            own = x[valid[:, d], d]
            assert np.isclose(state[1][d], own.mean(), rtol=1e-12) and np.isclose(state[2][d], own.var() * len(own), rtol=1e-9)
    with pytest.raises(ValueError, match="length"):
        moments.merged(state, moments.moments(x[:, :2], valid[:, :2]))


def test_vector_moments_over_restarts(spark):
    draw = np.random.default_rng(5)
    vectors = [(None if k % 17 == 0 else k % 3, None if k % 13 == 0 else [None if k % 7 == 1 else float(draw.normal()), float(k)]) for k in range(200)]
    path, out = scratch_path(spark, "vectors-in"), scratch_path(spark, "vectors-out")
    schema = "k int, v array<double>"
    for lot in range(3):
        for part in range(2):
            spark.createDataFrame(vectors[lot * 2 + part :: 6], schema).coalesce(1).write.mode("append").parquet(path)
        stream = running.file_stream(spark, path, spark.read.parquet(path).schema, files_per_batch=1)
        found = running.run_updated(moments.vector_moments(stream, "k", "v"), ["key"], "t", out)
    assert spark.read.parquet(f"{out}/table").select("batch").distinct().count() == 6
    rows = {(r.key, r.dim): r for r in moments.per_dimension(found).collect()}
    assert len(rows) == 8
    for (key, dim), r in rows.items():
        own = np.array([v[dim] for k, v in vectors if k == key and v is not None and v[dim] is not None])
        assert r.n == len(own) and np.isclose(r.mean, own.mean()) and np.isclose(r["std"], own.std())


def test_one_value_has_the_least_deviation_and_none_has_null(spark):
    found = spark.createDataFrame([(1, [1, 0], [2.0, 0.0], [0.0, 0.0])], "key int, n array<long>, mean array<double>, m2 array<double>")
    rows = moments.per_dimension(found).orderBy("dim").collect()
    assert [(r.n, r.mean, r["std"]) for r in rows] == [(1, 2.0, 1e-8), (0, None, None)]


def test_resent_rows_count_once_and_late_ones_do_not(spark):
    """Lots of (key, hour, value); each is a run of its own."""
    paths, out = [scratch_path(spark, s) for s in ("left", "right")], scratch_path(spark, "sums")
    lots = [
        ([(1, 0, 5), (2, 0, 7), (2, 0, 7)], [(1, 0, 1), (3, 0, 1)]),
        ([(1, 0, 5), (3, 1, 11)], [(2, 0, 1), (1, 0, 1)]),  # 1 is sent again, 2 and 3 meet their partners late
        ([(4, 9, 13), (9, 8, 100)], [(4, 9, 1), (9, 0, 1)]),  # 9: partners too far apart
        ([(5, 10, 17)], [(5, 10, 1)]),
        ([(6, 0, 1000)], [(6, 0, 1)]),  # far behind the watermark
    ]
    for left, right in lots:
        for path, rows, name in ((paths[0], left, "value"), (paths[1], right, "n")):
            df = spark.createDataFrame(rows, f"key int, hour int, {name} long")
            df.select("key", name, F.timestamp_seconds(F.lit(1_600_000_000) + 3600 * F.col("hour")).alias("ts")).coalesce(1).write.mode("append").parquet(path)
        sides = [running.file_stream(spark, p, spark.read.parquet(p).schema) for p in paths]
        pairs = running.paired(*sides, ["key"], "ts", "2 hours", "1 hour")
        found = running.run_summed(pairs.withColumn("of", F.lit("all")), ["of"], ["value", "n"], "t", out)
    assert tuple(found.first()) == ("all", 5 + 7 + 11 + 13 + 17, 5)


def test_predictions_are_scored_by_all_tasks(spark):
    assert entry.queries()["running_rates_x2"](spark, "/root/testdata/sf0.01").count() == 4
    path = next(p for p in reversed(scratch._made[spark.sparkContext.applicationId]) if "/predictions-" in p)
    assert len(spark.read.parquet(path).inputFiles()) >= spark.sparkContext.defaultParallelism
