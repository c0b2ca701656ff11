"""Error rates, accuracy, losses and confusion reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from speechlake.functions import edits, text

COUNTS = ["char_err", "char_len", "char_ns_err", "char_ns_len", "word_err", "word_len"]


def postprocess(df: DataFrame, column: str) -> DataFrame:
    """Clean recognised text in the fixed order: numbers, letters, percent signs, repeats.

    One column per step, so every step reads a computed value instead of
    repeating the expression below it.
    """
    spoken = df.withColumn(column, text.spell_numbers(F.col(column))).withColumn(column, text.spell_letters(F.col(column)))
    spoken = spoken.withColumn(column, text.spell_percent(F.col(column)))
    return spoken.withColumn(column, text.limit_repeats(F.col(column)))


def _at_least_one(length: Column) -> Column:
    return F.when(length == 0, F.lit(1)).otherwise(length).cast("int")


def scored_forms(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Replace both texts by the forms that are scored.

    The canonical form is taken once per side; the a-z form is used where it
    keeps enough of the target, else the form that keeps every script.
    """
    forms = df.withColumns(
        {"_p": text.nfd(F.coalesce(prediction, F.lit(""))), "_t": text.nfd(F.coalesce(target, F.lit("")))}
    ).withColumns(
        {
            "_pb": text.normalize_basic(F.col("_p")),
            "_tb": text.normalize_basic(F.col("_t")),
            "_pu": text.normalize_unicode(F.col("_p")),
            "_tu": text.normalize_unicode(F.col("_t")),
        }
    )
    basic = text.keeps_basic(F.col("_tb"), F.col("_tu"))
    return forms.withColumns(
        {
            prediction: F.when(basic, F.col("_pb")).otherwise(F.col("_pu")),
            target: F.when(basic, F.col("_tb")).otherwise(F.col("_tu")),
        }
    ).drop("_p", "_t", "_pb", "_tb", "_pu", "_tu")


def count_errors(df: DataFrame, prediction: str, target: str) -> DataFrame:
    """Six counts per row over texts that are already in scored form."""
    p, t = F.col(prediction), F.col(target)
    p_ns, t_ns = edits.without_space(p), edits.without_space(t)
    return df.withColumns(
        {
            "char_err": edits.char_distance(p, t),
            "char_len": _at_least_one(F.length(t)),
            "char_ns_err": edits.char_distance(p_ns, t_ns),
            "char_ns_len": _at_least_one(F.length(t_ns)),
            "word_err": edits.word_distance(p, t),
            "word_len": _at_least_one(F.size(edits.words(t))),
        }
    ).drop(prediction, target)


def error_counts(df: DataFrame, prediction: str = "prediction", target: str = "target") -> DataFrame:
    return count_errors(scored_forms(df, prediction, target), prediction, target)


def error_rates(counts: DataFrame, *by: str) -> DataFrame:
    """Micro-averaged rates, for the corpus or per group."""
    return counts.groupBy(*by).agg(
        (F.sum("char_err") / F.sum("char_len")).alias("cer"),
        (F.sum("char_ns_err") / F.sum("char_ns_len")).alias("cer_wo_space"),
        (F.sum("word_err") / F.sum("word_len")).alias("wer"),
    )


def symbol_error_rate(df: DataFrame, prediction: str, target: str, *by: str) -> DataFrame:
    """Edits per target symbol, per row group and in total (``by`` empty)."""
    scored = df.select(
        *by,
        edits.char_distance(F.col(prediction), F.col(target)).alias("err"),
        F.length(target).alias("len"),
    )
    return scored.groupBy(*by).agg(F.try_divide(F.sum("err"), F.sum("len")).alias("rate"))


def confusion_counts(frames: DataFrame, pred: str = "pred", target: str = "target", noise: str | None = None) -> DataFrame:
    """Sparse confusion matrix over frames whose target is not the noise label."""
    kept = frames if noise is None else frames.where(F.col(target) != noise)
    return kept.groupBy(F.col(pred).alias("pred"), F.col(target).alias("target")).agg(
        F.count(F.lit(1)).alias("n")
    )


def confused_pairs(counts: DataFrame, n: int = 10) -> DataFrame:
    """The n label pairs with the highest symmetric confusion."""
    return pair_confusions(counts).orderBy(F.desc("confusion"), F.desc("p"), F.desc("q")).limit(n)


def pair_confusions(counts: DataFrame) -> DataFrame:
    """Symmetric confusion of every label pair that was ever confused.

    A cell (p, q) counts for the unordered pair, so no label is joined with all
    others; totals and the diagonal come back by equality on the label. The pair
    table has at most one row per pair of inventory labels.
    """
    totals = counts.groupBy("target").agg(
        (F.sum("n") + 1e-4).alias("total"),
        F.sum(F.when(F.col("pred") == F.col("target"), F.col("n")).otherwise(0)).alias("hits"),
    )
    side = lambda name: totals.select(
        F.col("target").alias(name), F.col("total").alias(f"{name}_total"), F.col("hits").alias(f"{name}_hits")
    )
    pairs = (
        counts.where("pred <> target")
        .groupBy(F.greatest("pred", "target").alias("p"), F.least("pred", "target").alias("q"))
        .agg(F.sum("n").alias("swapped"))
        .join(side("p"), "p", "left")
        .join(side("q"), "q", "left")
    )
    both = F.coalesce("p_total", F.lit(1e-4)) + F.coalesce("q_total", F.lit(1e-4))
    hits = F.coalesce("p_hits", F.lit(0)) + F.coalesce("q_hits", F.lit(0))
    return pairs.select("p", "q", (F.col("swapped") / both).alias("confusion"), (hits / both).alias("accuracy"))


def masked_accuracy(frames: DataFrame, pred: str, target: str, noise: str | None, *by: str) -> DataFrame:
    """Share of right frames among those that count; 0 where none counts."""
    valid = F.lit(True) if noise is None else F.col(target) != F.lit(noise)
    return frames.groupBy(*by).agg(
        F.coalesce(
            F.try_divide(F.count_if(valid & (F.col(pred) == F.col(target))), F.count_if(valid)), F.lit(0.0)
        ).alias("accuracy"),
        F.count_if(valid).alias("frames"),
    )


def sequence_losses(
    frames: DataFrame, phone_weight: float, dim: int, noise_known: bool, dimension_norm: bool = False
) -> DataFrame:
    """Corpus losses from aligned frames with ``dist``, ``nll`` and ``valid``.

    With a noise label in the inventory the two terms have their own
    denominators and are combined afterwards; without it every frame counts in
    both. ``dist`` is the raw distance, it is divided by D here.
    """
    d = float(dim) ** 0.5 if dimension_norm else 1.0
    sums = frames.agg(
        (F.sum("dist") / d).alias("dist"),
        F.sum(F.when(F.col("valid"), F.col("nll")).otherwise(0.0)).alias("nll"),
        F.count(F.lit(1)).alias("n"),
        F.count_if("valid").alias("m"),
    )
    share = F.col("m") if noise_known else F.col("n")
    l_ph = F.coalesce(F.try_divide(F.col("nll"), share), F.lit(0.0))
    l_dist = F.col("dist") / F.col("n")
    return sums.select(
        (l_dist * 0.5 + phone_weight * l_ph / d).alias("loss"), l_dist.alias("loss_dist"), l_ph.alias("loss_ph")
    )
