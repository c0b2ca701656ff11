"""Column functions over arrays: trims, padding, masks and class scores.

A sequence is ``array<T>``; time is the array index.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from speechlake.functions.let import let


def trim_edges(seq: Column, left: int | Column, right: int | Column | None = None) -> Column:
    """Drop ``left`` and ``right`` steps; a sequence too short for that becomes empty."""
    zero = F.lit(0)
    left = F.greatest(F.lit(left) if isinstance(left, int) else left, zero)
    right = left if right is None else F.greatest(F.lit(right) if isinstance(right, int) else right, zero)
    rest = F.greatest(F.size(seq) - left - right, zero)
    return F.slice(seq, F.when(rest > 0, left + 1).otherwise(F.lit(1)), rest.cast("int"))


def center_trim(seq: Column, length: Column) -> Column:
    """Cut to ``length`` around the centre; an odd rest goes off the right end."""
    want = F.greatest(length, F.lit(0))
    left = F.floor((F.size(seq) - want) / F.lit(2)).cast("int")
    return F.when(F.size(seq) > want, F.slice(seq, left + 1, want.cast("int"))).otherwise(seq)


def pad_to(seq: Column, length: Column, filler: Column) -> Column:
    """Cut or fill at the end to exactly ``length`` steps."""
    missing = F.greatest(length - F.size(seq), F.lit(0)).cast("int")
    return F.concat(F.slice(seq, F.lit(1), length.cast("int")), F.array_repeat(filler, missing))


def padding_mask(length: Column, total: Column) -> Column:
    """True for padding: positions at or after ``length``."""
    steps = F.when(total > 0, F.sequence(F.lit(0), (total - 1).cast("int"))).otherwise(F.array().cast("array<int>"))
    return F.transform(steps, lambda p: p >= length)


def pick_channels(frame: Column, channels: list[int]) -> Column:
    """The listed channels in the listed order."""
    return F.array(*[F.get(frame, F.lit(c)) for c in channels])


def top_k(values: Column, k: int) -> Column:
    """Keep the k largest entries and zero the rest; ties keep the earlier entry."""
    ranked = lambda v, i: F.struct((-v).alias("loss"), i.alias("at"))
    return let(
        F.struct(values.alias("v"), F.get(F.array_sort(F.transform(values, ranked)), F.lit(k - 1)).alias("cut")),
        lambda both: F.transform(
            both["v"],
            lambda v, i: F.when(both["cut"].isNull() | (ranked(v, i) <= both["cut"]), v).otherwise(F.lit(0.0)),
        ),
    )


def log_softmax(scores: Column) -> Column:
    """Log probabilities with the maximum taken out first."""
    total = lambda s: F.aggregate(s["x"], F.lit(0.0), lambda a, x: a + F.exp(x - s["top"]))
    shifted = let(
        F.struct(scores.alias("x"), F.array_max(scores).alias("top")),
        lambda s: F.struct(s["x"].alias("x"), (s["top"] + F.log(total(s))).alias("log_sum")),
    )
    return let(shifted, lambda s: F.transform(s["x"], lambda x: x - s["log_sum"]))


def argmax(scores: Column) -> Column:
    """0-based place of the first maximum."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def argmax_without(scores: Column, special: list[int], shift: int) -> Column:
    """Best class when special ids are masked out, renumbered by ``shift``."""
    masked = F.transform(
        scores, lambda s, i: F.when(i.isin(special), F.lit(float("-inf"))).otherwise(s)
    )
    return argmax(masked) - shift


def cross_entropy(scores: Column, target: Column, ignore: int | None = None) -> Column:
    """Negative log probability of the target class; 0 for the ignored one."""
    nll = -F.get(log_softmax(scores), target)
    return nll if ignore is None else F.when(target == ignore, F.lit(0.0)).otherwise(nll)


def distance(a: Column, b: Column, eps: float = 0.0) -> Column:
    """Euclidean distance of two vectors; ``eps`` is added to every difference."""
    squares = F.zip_with(a, b, lambda x, y: F.pow(x - y + F.lit(eps), F.lit(2.0)))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda s, x: s + x))


def mean_abs_difference(a: Column, b: Column) -> Column:
    gaps = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    return F.aggregate(gaps, F.lit(0.0), lambda s, x: s + x) / F.size(a)


def drop_unit_axis(seq: Column) -> Column:
    """First matrix of a stack of one; a larger stack is an error."""
    wrong = F.raise_error(F.concat(F.lit("expected one matrix, found "), F.size(seq).cast("string")))
    return F.when(F.size(seq) == 1, F.get(seq, F.lit(0))).otherwise(wrong)


def has_width(matrix: Column, width: int) -> Column:
    """Whether every step of a matrix has the expected width."""
    return F.forall(matrix, lambda frame: F.size(frame) == width)
