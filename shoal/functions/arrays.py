"""Rich slices, regex groups and distances over arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def span(start: int | None = None, stop: int | None = None, step: int = 1, inclusive: bool = False) -> tuple:
    """A range of indices for rich_slice; None is the end that the step comes from or goes to."""
    if step == 0:
        raise ValueError("a step of 0")
    return start, stop, step, inclusive


def _indices(size: Column, one) -> Column:
    """one: an index, "*" or a span; negative numbers count from the end, but a stop of -1 going down is literal."""
    at = lambda i: size + i if i < 0 else F.lit(i)
    if isinstance(one, int):
        return F.array(at(one))
    start, stop, step, inclusive = span() if one == "*" else one
    up = step > 0
    first = at(start) if start is not None else F.lit(0) if up else size - 1
    if stop is None:
        last = size - 1 if up else F.lit(0)
    else:
        last = F.lit(-1) if stop == -1 and not up else at(stop)
        last = last if inclusive else last - (1 if up else -1)
    some = first <= last if up else first >= last
    return F.when(some, F.sequence(first, F.when(some, last).otherwise(first), F.lit(step))).otherwise(F.array().cast("array<int>"))


def rich_slice(values: Column, *slices) -> Column:
    """Elements at indices and ranges, one after the other; a place outside is null."""
    size = F.size(values)
    return F.transform(F.flatten(F.array(*[_indices(size, s) for s in slices])), lambda i: F.get(values, i))


def regex_groups(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that matches all of the text; null if it doesn't."""
    whole = f"^(?:{pattern})$"
    return F.when(text.rlike(whole), F.array(*[F.regexp_extract(text, whole, i + 1) for i in range(groups)]))


def hamming(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: (~x.eqNullSafe(y)).cast("double")), F.lit(0.0), lambda s, x: s + x)


def manhattan(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def gaussian(distance: Column, sigma: float) -> Column:
    return F.exp(-(distance * distance) / F.lit(float(sigma) ** 2))
