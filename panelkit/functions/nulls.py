"""Missing values: NULL is the only one; NaN and infinities become NULL at the border and after every operator."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Divisors of a size up to this count as zero in factor division (fixed value).
EPSILON = 1e-10


def null() -> Column:
    return F.lit(None).cast("double")


def clean(x: Column) -> Column:
    return F.when(~F.isnan(x) & (F.abs(x) != F.lit(math.inf)), x)


def to_double(x: Column) -> Column:
    """Numeric coercion: what is no number is missing."""
    return clean(x.try_cast("double"))


def safe_div(x: Column, y: Column) -> Column:
    return F.when(F.abs(y) > EPSILON, x / y)


def div_nonzero(x: Column, y: Column) -> Column:
    return F.when(y != 0, x / y)


def compare(condition: Column, missing: float) -> Column:
    """0 or 1; ``missing`` where a side is missing."""
    return F.coalesce(condition.cast("double"), F.lit(float(missing)))


def both(x: Column, y: Column, value: Column) -> Column:
    return F.when(x.isNotNull() & y.isNotNull(), value)
