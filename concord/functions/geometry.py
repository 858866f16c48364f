"""Rings as arrays of vertices, and what is done to them, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from concord.functions.binding import let

VERTEX = "struct<x:double,y:double,z:double>"


def _vertex(x: Column, y: Column, z: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"), z.alias("z"))


def turn(ring: Column, degrees: Column) -> Column:
    """The ring turned about the origin by an angle counted against the clock."""
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return F.transform(ring, lambda v: _vertex(v["x"] * c - v["y"] * s, v["x"] * s + v["y"] * c, v["z"]))


def shift(ring: Column, x: Column, y: Column, z: Column) -> Column:
    return F.transform(ring, lambda v: _vertex(v["x"] + x, v["y"] + y, v["z"] + z))


def reverse_held(ring: Column) -> Column:
    """The ring reversed with its first vertex held. Twice is never."""
    return F.when(F.size(ring) < 2, ring).otherwise(F.concat(F.slice(ring, 1, 1), F.reverse(F.slice(ring, F.lit(2), F.size(ring) - 1))))


def vertex_error(a: Column, b: Column) -> Column:
    """The largest disagreement on one coordinate; not a distance."""
    return F.greatest(F.abs(a["x"] - b["x"]), F.abs(a["y"] - b["y"]), F.abs(a["z"] - b["z"]))


def comparable(a: Column, b: Column) -> Column:
    return (F.size(a) == F.size(b)) & (F.size(a) > 0)


def ring_error(a: Column, b: Column) -> Column:
    """The least, over the cyclic rotations, of the largest vertex error. The reversal is never
    tried. Null for rings of unlike length and for empty rings."""
    def least(a: Column, b: Column) -> Column:
        n = F.size(a)
        turned = lambda by: F.concat(F.slice(a, by + 1, n - by), F.slice(a, F.lit(1), by))
        worst = lambda by: F.array_max(F.zip_with(turned(by), b, lambda p, q: vertex_error(p, q)))
        return F.when(comparable(a, b), F.array_min(F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), worst)))

    return let(F.struct(a.alias("a"), b.alias("b")), lambda both: least(both["a"], both["b"]))


def index_error(a: Column, b: Column) -> Column:
    """The same with no rotation search: vertex one against vertex one."""
    return F.when(comparable(a, b), F.array_max(F.zip_with(a, b, lambda p, q: vertex_error(p, q))))
