"""Every query with a SQL counterpart, side by side on the smallest tables."""

from __future__ import annotations

import pytest

from compare import compare, connect
from speechlake.plans import REGISTRY

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", list(REGISTRY))
def test_query_matches_sql(spark, con, name):
    same, note, _ = compare(spark, con, REGISTRY[name], SF)
    assert same, note
