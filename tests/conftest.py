from __future__ import annotations

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry
from speechlake.session import local_session
from speechlake.sources.scratch import release


@pytest.fixture(scope="session")
def spark():
    session = local_session(8, 4)
    entry._ship(session)
    yield session
    release(session)
    session.stop()


@pytest.fixture
def one(spark):
    """Evaluate column expressions over a list of strings."""
    from pyspark.sql import functions as F

    def run(texts, *made):
        df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, s string")
        rows = df.select("i", *[m(F.col("s")).alias(f"c{n}") for n, m in enumerate(made)]).orderBy("i").collect()
        return [tuple(r)[1] if len(made) == 1 else tuple(r)[1:] for r in rows]

    return run
