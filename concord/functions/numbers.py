"""Number rules as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed value: relative tolerance of number comparison.
RELATIVE_TOLERANCE = 1e-12

# Fixed pattern: the texts a decimal number may have, once trimmed. `1d`, `0x1` and the
# like are text although a plain Spark cast would read some of them.
NUMBER_TEXT = r"^[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?$"


def is_finite(x: Column) -> Column:
    return ~(F.isnan(x) | x.isin(float("inf"), float("-inf")))


def num_equal(a: Column, b: Column, nan_equal: bool = False) -> Column:
    """Equal, or within the relative tolerance. There is no absolute floor.

    NaN and the infinities equal nothing, themselves included, unless ``nan_equal`` (the
    sweep's rule: NaN equals NaN, an infinity equals itself). Spark holds NaN = NaN, so
    finiteness is tested first.
    """
    a, b = a.cast("double"), b.cast("double")
    finite = is_finite(a) & is_finite(b)
    near = (a == b) | (F.abs(a - b) <= F.lit(RELATIVE_TOLERANCE) * F.greatest(F.abs(a), F.abs(b)))
    if nan_equal:
        return F.when(finite, near).otherwise(a == b)
    return F.when(finite, near).otherwise(F.lit(False))


def read_number(text: Column) -> Column:
    """The double a text holds, or null when the text is not a number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_TEXT), trimmed.try_cast("double"))


def print_tolerance(decimal_places: Column) -> Column:
    """Half the last printed place."""
    return F.lit(0.5) * F.pow(F.lit(10.0), -decimal_places)
