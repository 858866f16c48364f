"""Running values over arrays, in one row."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.binding import let

# Elements of a block; blocks of blocks of this size are folded one by one.
BLOCK = 64


def _fold(values: Column, begin: Column, n: Column, fn: Callable[[Column, Column], Column], zero: int) -> Column:
    return F.aggregate(F.slice(values, begin + 1, n), F.lit(zero).cast("long"), fn)


def running(values: Column, fn: Callable[[Column, Column], Column], zero: int = 0) -> Column:
    """For each element of an array of longs, ``fn`` over all elements before it (``zero`` for the first).

    An element folds what precedes it in its block, and the same holds for the blocks and the blocks of blocks, so the cost
    is linear up to some ten million elements and no array grows step by step.
    """
    rank = lambda i: F.floor(i / BLOCK).cast("int")
    below = lambda i: (i % BLOCK).cast("int")

    def blocks(v: Column) -> Column:
        every = F.sequence(F.lit(0), F.ceil(F.size(v) / BLOCK).cast("int") - 1)
        return F.when(F.size(v) > 0, F.transform(every, lambda b: _fold(v, b * BLOCK, F.lit(BLOCK), fn, zero))).otherwise(F.array().cast("array<long>"))

    def before(v: Column, whole: Column) -> Column:
        return F.transform(v, lambda _, i: fn(F.get(whole, rank(i)), _fold(v, rank(i) * BLOCK, below(i), fn, zero)))

    return let(
        values,
        lambda v: let(
            blocks(v),
            lambda one: let(
                blocks(one),
                lambda two: let(
                    before(one, F.transform(two, lambda _, i: _fold(two, F.lit(0), i, fn, zero))),
                    lambda whole: before(v, whole),
                ),
            ),
        ),
    )


def running_sum(values: Column) -> Column:
    return running(values, lambda a, b: a + b)


def running_max(values: Column, least: int) -> Column:
    return running(values, lambda a, b: F.greatest(a, b), least)
