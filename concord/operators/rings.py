"""Rings brought to world coordinates and compared with a report of the same rings.

Rings are (model, name, kind, zone, vertices); rules one row per model (coordinate_system,
north_axis, entry_direction, starting_vertex); zones (model, zone, x, y, z, rel_north).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.functions import geometry as g
from concord.operators.skew import lookup_join

# Fixed value: half the last printed place of the report, in metres.
TOLERANCE = 0.005

# Fixed value: shading fixed to the site does not turn with the building.
SITE_FIXED = "Shading:Site:Detailed"

# Prefixes of rows that a report's producer made itself.
GENERATED = {"mir-": "mirrored", "iz-": "interzone"}


def is_relative(system: Column) -> Column:
    return F.lower(system) == "relative"


def is_clockwise(entry: Column) -> Column:
    return F.lower(entry).startswith("clockwise")


def with_rules(rings: DataFrame, rules: DataFrame, zones: DataFrame) -> DataFrame:
    """Rings with what their model and their zone declare. Zone names meet in any casing."""
    ruled = lookup_join(rings, rules, ["model"])
    origins = zones.select("model", F.upper("zone").alias("_zone"), "x", "y", "z", "rel_north")
    return lookup_join(ruled.withColumn("_zone", F.upper("zone")), origins, ["model", "_zone"]).drop("_zone")


def to_building(ring: Column) -> Column:
    """Clause one: under a relative system turn by the zone's own north and add its origin."""
    there = F.col("x").isNotNull() & F.coalesce(is_relative(F.col("coordinate_system")), F.lit(False))
    turned = g.turn(ring, -F.coalesce("rel_north", F.lit(0.0)))
    return F.when(there, g.shift(turned, F.col("x"), F.col("y"), F.col("z"))).otherwise(ring)


def turns_with_building(kind: Column) -> Column:
    return F.coalesce(F.lower(kind) != SITE_FIXED.lower(), F.lit(True))


def rotate_north(ring: Column) -> Column:
    """Clause two: turn about the origin by minus the north axis; site-fixed shading stays."""
    axis = F.coalesce("north_axis", F.lit(0.0))
    return F.when((axis != 0) & turns_with_building(F.col("kind")), g.turn(ring, -axis)).otherwise(ring)


def orient(ring: Column) -> Column:
    """Clause three: a ring entered clockwise is reversed, its first vertex held."""
    return F.when(F.coalesce(is_clockwise(F.col("entry_direction")), F.lit(False)), g.reverse_held(ring)).otherwise(ring)


def to_world(rings: DataFrame, rules: DataFrame, zones: DataFrame) -> DataFrame:
    """All three clauses."""
    ruled = with_rules(rings, rules, zones)
    return ruled.withColumn("vertices", orient(rotate_north(to_building(F.col("vertices"))))).select(*rings.columns)


def undo_origin(ring: Column) -> Column:
    """What leaving out clause one's condition does: the origin, turned by the axis, is added
    where the system is not relative. Rings of no zone stay."""
    axis = -F.coalesce("north_axis", F.lit(0.0))
    c, s = F.cos(F.radians(axis)), F.sin(F.radians(axis))
    moved = g.shift(ring, F.col("x") * c - F.col("y") * s, F.col("x") * s + F.col("y") * c, F.col("z"))
    there = F.col("x").isNotNull() & ~F.coalesce(is_relative(F.col("coordinate_system")), F.lit(False))
    return F.when(there, moved).otherwise(ring)


def undo_axis(ring: Column) -> Column:
    """Exact inverse of clause two."""
    axis = F.coalesce("north_axis", F.lit(0.0))
    return F.when((axis != 0) & turns_with_building(F.col("kind")), g.turn(ring, axis)).otherwise(ring)


# Clause three is its own inverse.
undo_orient = orient


def compare_rings(left: DataFrame, right: DataFrame, tolerance: float = TOLERANCE, by_index: bool = False) -> DataFrame:
    """Every resolved ring against the reported one: error, and the reasons it fails (may be none).

    Names meet upper-cased within a model. ``left`` has (model, name, parent, vertices), ``right``
    (model, name, base_surface, vertices).
    """
    reported = right.groupBy("model", F.upper("name").alias("_name")).agg(
        F.max(F.struct("base_surface", "vertices")).alias("_r")
    )
    joined = left.withColumn("_name", F.upper("name")).join(reported, ["model", "_name"], "left")
    theirs = F.col("_r")["vertices"]
    error = (g.index_error if by_index else g.ring_error)(F.col("vertices"), theirs)
    judged = joined.withColumn("error", error)
    parent = F.coalesce(F.col("parent"), F.lit(""))
    reasons = F.filter(
        F.array(
            F.when(F.col("_r").isNull(), "unmatched"),
            F.when(F.col("_r").isNotNull() & F.col("error").isNull(), "not comparable"),
            F.when(F.col("error") > tolerance, "apart"),
            F.when(
                F.col("error").isNotNull() & (parent != "") & (F.upper(parent) != F.upper(F.coalesce(F.col("_r")["base_surface"], F.lit("")))),
                "parent",
            ),
        ),
        lambda r: r.isNotNull(),
    )
    return judged.select("model", "name", "error", reasons.alias("reasons"))


def omissions(left: DataFrame, right: DataFrame, unattempted: DataFrame) -> DataFrame:
    """Reported rings that nothing matched, except in models that name types they did not attempt."""
    resolved = left.select("model", F.upper("name").alias("_name")).distinct()
    missing = right.withColumn("_name", F.upper("name")).join(resolved, ["model", "_name"], "left_anti").drop("_name")
    return lookup_join(missing, unattempted.select("model").distinct(), ["model"], "left_anti").select("model", "name")


def ring_summary(compared: DataFrame, omitted: DataFrame | None = None) -> DataFrame:
    """Per model: compared rings, failures, worst error (within tolerance or not)."""
    rows = compared.select("model", "error", F.size("reasons").cast("long").alias("_failures"))
    if omitted is not None:
        rows = rows.unionByName(omitted.select("model", F.lit(None).cast("double").alias("error"), F.lit(1).cast("long").alias("_failures")))
    return rows.groupBy("model").agg(
        F.count("error").alias("compared"), F.sum("_failures").alias("failures"), F.max("error").alias("worst")
    )


def drop_reason(name: Column, vertices: Column) -> Column:
    """Why a reported ring is dropped: its producer made it, or it has no vertices."""
    reason = F.when(F.lit(False), F.lit(""))
    for prefix, why in GENERATED.items():
        reason = reason.when(F.lower(name).startswith(prefix), why)
    return reason.when(F.size(vertices) == 0, "no vertices")


def drop_generated(rings: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Kept rings, and how many were dropped for each reason."""
    judged = rings.withColumn("reason", drop_reason(F.col("name"), F.col("vertices")))
    return judged.where("reason IS NULL").drop("reason"), judged.where("reason IS NOT NULL").groupBy("reason").agg(
        F.count(F.lit(1)).alias("dropped")
    )


def ablation_verdict(summary: DataFrame, guards: DataFrame, scope: DataFrame) -> DataFrame:
    """Whether leaving a clause out is noticed, per guard.

    ``summary`` is (guard, model, failures, worst), ``guards`` (guard, fails_on, at_least),
    ``scope`` (guard, model) the models whose declarations put the clause in scope. The named
    model must fail, by at least the recorded size, and no model out of scope may fail.
    """
    rows = lookup_join(summary, guards, ["guard"], "inner")
    rows = lookup_join(rows, scope.select("guard", "model").distinct().withColumn("_in", F.lit(True)), ["guard", "model"])
    named = F.col("model") == F.col("fails_on")
    judged = rows.groupBy("guard").agg(
        F.max("at_least").alias("at_least"),
        F.coalesce(F.max(F.when(named, F.col("failures"))), F.lit(0)).alias("failures"),
        F.coalesce(F.max(F.when(named, F.col("worst"))), F.lit(0.0)).alias("worst"),
        F.sum(((F.col("failures") > 0) & ~named & F.col("_in").isNull()).cast("long")).alias("untouched_failing"),
    )
    verdict = (
        F.when(F.col("failures") == 0, "did not fail")
        .when(F.col("worst") < F.col("at_least"), "too small")
        .when(F.col("untouched_failing") > 0, "fails out of scope")
        .otherwise("holds")
    )
    return judged.withColumn("verdict", verdict)
