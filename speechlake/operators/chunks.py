"""Index windows over long sequences without one task per sequence.

A sequence in long view has one row per (keys, t) with a dense ``t`` from 0. It
is cut into chunks of ``CHUNK`` samples, so no task ever holds more than one
chunk plus the few halo rows its window needs, however long the sequence is.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window
from pyspark.sql.window import WindowSpec

CHUNK = 1 << 16


def spread(df: DataFrame, *keys: str, least: int = 1) -> DataFrame:
    """Hash-partition by key, ``least`` ways or more, before work that is costly per row.

    The explicit count keeps adaptive execution from merging partitions that are
    small in bytes but not in work; joins and groupings on the keys reuse it.
    """
    session = df.sparkSession
    wanted = int(session.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(wanted, session.sparkContext.defaultParallelism, least), *keys)


def chunk_of(t: str | Column = "t", size: int = CHUNK) -> Column:
    col = F.col(t) if isinstance(t, str) else t
    return F.floor(col / F.lit(size)).cast("long")


def with_halo(df: DataFrame, before: int, after: int, size: int = CHUNK, t: str = "t") -> DataFrame:
    """Copy each row to the chunks whose window may read it.

    Adds ``chunk`` and ``own``; after the window keep the ``own`` rows only.
    A chunk reads ``before`` samples ahead of its start and ``after`` past its end.
    """
    col = F.col(t)
    first = F.greatest(F.floor((col - after) / F.lit(size)), F.lit(0)).cast("long")
    last = F.floor((col + before) / F.lit(size)).cast("long")
    return df.withColumn("chunk", F.explode(F.sequence(first, last))).withColumn(
        "own", F.col("chunk") == chunk_of(t, size)
    )


def chunk_window(keys: list[str], t: str = "t") -> WindowSpec:
    return Window.partitionBy(*keys, "chunk").orderBy(t)


def own_rows(df: DataFrame) -> DataFrame:
    return df.where("own").drop("own", "chunk")


def attach_stats(
    df: DataFrame, stats: DataFrame, keys: list[str], n: str, t: str = "t", size: int = CHUNK
) -> DataFrame:
    """Join per-sequence values back to the samples on (keys, chunk).

    ``stats`` has one row per key and the sequence length in column ``n``. It is
    repeated once per chunk, so a very long sequence joins as many small keys.
    """
    last = F.greatest(F.floor((F.col(n) - 1) / F.lit(size)), F.lit(0)).cast("long")
    spread = stats.withColumn("_chunk", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    return (
        df.withColumn("_chunk", chunk_of(t, size))
        .join(spread, [*keys, "_chunk"], "inner")
        .drop("_chunk")
    )
