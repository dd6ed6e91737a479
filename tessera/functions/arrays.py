"""Functions on arrays of tokens and numbers, as Column factories."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tessera.functions.text import let

IGNORED = -100  # fixed value: the label of a position that doesn't count


def positions_of(array: Column, needle: list) -> Column:
    """0-based starts of every occurrence of ``needle``, overlapping ones included; none for an empty needle."""
    n = len(needle)
    if n == 0:
        return F.array().cast("array<int>")
    starts = F.sequence(F.lit(0), F.size(array) - n)

    def matches(i: Column) -> Column:  # element by element: a slice would copy the array each time
        out = F.lit(True)
        for k, x in enumerate(needle):
            out = out & (F.element_at(array, i + k + 1) == F.lit(x))
        return out

    return F.when(F.size(array) >= n, F.filter(starts, matches)).when(array.isNotNull(), F.array().cast("array<int>"))


def rolled(array: Column, fill: Column) -> Column:
    """Shifted one to the left, with ``fill`` at the end."""
    return F.when(F.size(array) > 0, F.concat(F.slice(array, 2, F.size(array) - 1), F.array(fill))).otherwise(array)


def padded(array: Column, length: int, fill: Column, left: bool = False) -> Column:
    """Cut or padded to ``length``."""
    cut = F.slice(array, 1, length)
    room = F.array_repeat(fill, F.greatest(F.lit(0), F.lit(length) - F.size(array)))
    return F.concat(room, cut) if left else F.concat(cut, room)


def attention_mask(array: Column, length: int, left: bool = False) -> Column:
    """1 where ``padded`` keeps an element, 0 where it pads."""
    return padded(F.transform(array, lambda _: F.lit(1)), length, F.lit(0), left)


def counted_labels(labels: Column) -> Column:
    """Number of labels that aren't ignored."""
    return F.size(F.filter(labels, lambda x: x != IGNORED))


def softmax(scores: Column) -> Column:
    powers = let(F.array_max(scores), lambda top: F.transform(scores, lambda x: F.exp(x - top)))
    return let(
        F.struct(powers.alias("p")),
        lambda s: let(F.aggregate(s["p"], F.lit(0.0), lambda a, x: a + x), lambda total: F.transform(s["p"], lambda x: x / total)),
    )


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def entropy(probabilities: Column) -> Column:
    """-sum p ln(p + 1e-12)."""
    return -F.aggregate(probabilities, F.lit(0.0), lambda a, p: a + p * F.log(p + 1e-12))


def argmax(scores: Column) -> Column:
    """0-based place of the largest element, the first of equals."""
    return (F.array_position(scores, F.array_max(scores)) - 1).cast("int")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; NULL where a vector has no length."""
    return F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)))


def min_max(scores: Column) -> Column:
    """(x - min) / (max - min + 1e-5); a constant vector becomes 0 where it is 0, else min(1, x)."""
    return let(
        F.struct(F.array_min(scores).alias("low"), F.array_max(scores).alias("high")),
        lambda b: F.transform(
            scores,
            lambda x: F.when(b["low"] == b["high"], F.when(b["low"] == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), b["low"]))).otherwise((x - b["low"]) / (b["high"] - b["low"] + 1e-5)),
        ),
    )


def linspace(low: Column, high: Column, n: int) -> Column:
    """n evenly spaced numbers from low to high, both included."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: low + i * (high - low) / (n - 1))


def uniform_indices(length: Column, n: int) -> Column:
    """The n mid-points of equal gaps: floor(i * gap + gap / 2)."""
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.floor((i + 0.5) * length / n).cast("int"))


def lower_bound(sorted_array: Column, x: Column) -> Column:
    """0-based place of the first element that is at least x; the size if none is."""
    return F.size(F.filter(sorted_array, lambda v: v < x))


def upper_bound(sorted_array: Column, x: Column) -> Column:
    """0-based place of the first element above x; the size if none is."""
    return F.size(F.filter(sorted_array, lambda v: v <= x))


def ntile_of(index: Column, total: Column, parts: int) -> Column:
    """Part (0-based) of a balanced contiguous split: the first ``total % parts`` parts have one element more."""
    base, more = F.floor(total / parts), F.pmod(total, F.lit(parts))
    edge = more * (base + 1)
    return F.when(index < edge, F.floor(index / (base + 1))).otherwise(more + F.floor(F.try_divide(index - edge, base))).cast("int")
