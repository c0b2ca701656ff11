"""What the operators of this package share: registry, tables, word rules."""

from __future__ import annotations

import shutil
import tempfile
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
# Characters between words: ASCII white space.
BLANK = r"[\x20\x09-\x0D]+"


def query(name: str, sql: str | None = None):
    """Register a query; ``sql`` must return the same columns and rows."""

    def register(plan):
        QUERIES[name] = plan
        if sql is not None:
            SQL[name] = sql
        return plan

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Send the package to the Python workers once per session."""
    context = spark.sparkContext
    if getattr(context, "_speechlake_shipped", False):
        return
    root = Path(__file__).resolve().parents[2]
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.addPyFile(shutil.make_archive(f"{folder}/speechlake", "zip", str(root), "speechlake"))
    context._speechlake_shipped = True


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case; other letters stay."""
    return F.translate(text, UPPER, LOWER)


def blank_words(text: Column) -> Column:
    """Words between ASCII white space; null and blank texts have none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), BLANK), lambda w: w != "")


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """Rows of the largest ``n``, ``most`` at most.

    Counts are compared by eighths of a power of two, so the driver sees a few
    hundred class sizes and no task sends more than its share of the result.
    """
    levels = counts.withColumn("level", F.floor(8 * F.log2("n")).cast("int"))
    least, total = None, 0
    for row in sorted(levels.groupBy("level").count().collect(), reverse=True):
        total += row["count"]
        if total > most:
            break
        least = row["level"]
    return levels.where(F.lit(False) if least is None else F.col("level") >= least)
