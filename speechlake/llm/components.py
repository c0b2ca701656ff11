"""Connected components of a table of links.

Alternating large-star and small-star steps (Kiveris et al., 2014). Each step
needs the smallest neighbour per node, which is a partial aggregate, and a join
with it, which adaptive execution splits where a node has many links. Every
step is written to the shared folder, so the lineage stays short.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.sources.scratch import stored


def _star(links: DataFrame, label: str) -> DataFrame:
    """``(u, v)`` with the smallest neighbour of ``u`` not above ``u`` itself."""
    least = stored(links.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), f"{label}-least")
    return links.join(least, "u")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    return _star(both, "large").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()


def _small(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u <> v")
    starred = _star(down, "small")
    pulled = starred.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return pulled.union(starred.select("u", F.col("m").alias("v"))).where("u <> v").distinct()


def _mark(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``links(u, v)``; the root is the
    smallest node of the component. No links give no rows."""
    edges = stored(links.select("u", "v").where("u <> v").distinct(), "links")
    mark = _mark(edges)
    while mark[0]:
        edges = stored(_small(stored(_large(edges), "large")), "small")
        now = _mark(edges)
        if now == mark:
            break
        mark = now
    roots = edges.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
