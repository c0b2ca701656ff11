"""Pronunciation by lexicon."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from speechlake.functions.edits import words

def pronounce(df: DataFrame, keys: list[str], texts: list[str], lexicon: DataFrame) -> DataFrame:
    """Replace every word of the text columns by its phones; unknown words stay.

    ``lexicon`` has (word, phones). Adaptive execution splits the join where a
    word is frequent, and a text comes back together by its own key.
    """
    entries = df.select(
        *keys,
        F.inline(F.array(*[F.struct(F.lit(c).alias("_side"), words(F.col(c)).alias("_words")) for c in texts])),
    ).select(*keys, "_side", F.posexplode("_words").alias("_pos", "word"))
    spoken = entries.join(lexicon, "word", "left").withColumn("_said", F.coalesce("phones", "word"))
    said = lambda c: F.array_join(
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("_side") == c, F.struct("_pos", "_said")))), lambda w: w["_said"]
        ),
        " ",
    )
    rebuilt = spoken.groupBy(*keys).agg(*[said(c).alias(c) for c in texts])
    # A text without any word has no entry; it comes back empty.
    return df.select(*keys).join(rebuilt, keys, "left").select(
        *keys, *[F.coalesce(c, F.lit("")).alias(c) for c in texts]
    )
