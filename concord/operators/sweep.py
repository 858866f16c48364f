"""N-way sweep: who agrees with whom at every place, and which disagreements are one bug.

Sides are a short fixed list given by the caller; places, files and shapes are data.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from concord.functions.json import ancestors, pointer_pattern, preview
from concord.functions.numbers import num_equal
from concord.operators.nodes import align_sides, topmost
from concord.operators.skew import first_members

def _equal_here(a: str, b: str) -> Column:
    """Two sides' values at one place, without looking beneath it."""
    l, r = F.col(a), F.col(b)
    kind = l["jtype"]
    same = (
        F.when(kind == "number", num_equal(l["num"], r["num"], nan_equal=True))
        .when(kind == "string", l["str"] == r["str"])
        .when(kind == "boolean", l["bool"] == r["bool"])
        .when(kind == "array", l["size"] == r["size"])
        .otherwise(F.lit(True))
    )
    return F.when(l.isNull() | r.isNull(), l.isNull() & r.isNull()).when(kind != r["jtype"], F.lit(False)).otherwise(F.coalesce(same, F.lit(False)))


def _pairs(sides: Sequence[str]) -> list[tuple[int, int]]:
    return [(i, j) for j in range(len(sides)) for i in range(j)]


def _partition(sides: Sequence[str], equal: dict[tuple[int, int], Column]) -> dict[int, Column]:
    """For each side the first member of its group: greedy, in side order. Null: took no part."""
    group: dict[int, Column] = {}
    for j, side in enumerate(sides):
        chosen = F.lit(j)
        for i in reversed(range(j)):
            chosen = F.when((F.coalesce(group[i], F.lit(-1)) == i) & equal[i, j], F.lit(i)).otherwise(chosen)
        group[j] = F.when(F.col(f"has_{side}"), chosen)
    return group


def partition_label(sides: Sequence[str], group: Sequence[Column]) -> Column:
    """``a=c | b``: groups by their first member, members in side order."""
    return F.concat_ws(
        " | ",
        *[
            F.when(group[i] == i, F.concat_ws("=", *[F.when(group[j] == i, sides[j]) for j in range(i, len(sides))]))
            for i in range(len(sides))
        ],
    )


def minority_sides(sides: Sequence[str], group: Sequence[Column]) -> Column:
    """Members of every group smaller than the largest; of every group when the largest is one."""
    n = len(sides)
    count = [sum((F.coalesce((group[j] == i).cast("int"), F.lit(0)) for j in range(n)), F.lit(0)) for i in range(n)]
    largest = F.greatest(*count)
    return F.concat_ws(
        ",",
        *[
            F.when((group[j] == i) & ((count[i] < largest) | (largest == 1)), sides[j])
            for i in range(n)
            for j in range(i, n)
        ],
    )


def sweep_diff(aligned: DataFrame, ids: Sequence[str], sides: Sequence[str], nested: bool = True, max_chars: int = 200) -> DataFrame:
    """Places where the sides disagree: kind, partition, differing sides, types, shape, values.

    Kinds: ``absent`` before ``type`` before ``value``; ``length`` for arrays, whose shared prefix
    is still compared. Nothing is reported beneath an absence or a clash of types. ``nested=False``
    states that the places are all leaves, which saves the look beneath and above them.
    """
    pairs = _pairs(sides)
    kinds = [F.when(F.col(f"has_{s}"), F.coalesce(F.col(s)["jtype"], F.lit("absent"))) for s in sides]
    here = aligned.select(
        "*",
        F.array_distinct(F.filter(F.array(*kinds), lambda k: k.isNotNull())).alias("_kinds"),
        F.coalesce(*[F.col(s)["ord"] for s in sides]).alias("ord"),
        F.array_distinct(F.filter(F.array(*[F.col(s)["trail"] for s in sides]), lambda t: t.isNotNull())).alias("_trails"),
        *[
            (F.col(f"has_{sides[i]}") & F.col(f"has_{sides[j]}") & ~_equal_here(sides[i], sides[j])).alias(f"_ne_{i}_{j}")
            for i, j in pairs
        ],
    )
    any_ne = F.exists(F.array(*[F.col(f"_ne_{i}_{j}") for i, j in pairs]), lambda ne: F.coalesce(ne, F.lit(False)))
    # Equal places on unlike trails are kept for now: what hangs beneath them is no finding either.
    unlike = here.where(any_ne | (F.size("_trails") > 1))
    if nested:
        # Two containers differ when anything beneath them does: every unlike place tells its
        # ancestors. The places themselves pass through the same aggregation, so nothing is read twice.
        kept = [c for c in unlike.columns if c not in (*ids, "ptr")]
        itself = F.struct(F.col("ptr").alias("at"), F.struct(*kept).alias("row"))
        above = F.transform(ancestors(F.col("ptr")), lambda p: F.struct(p.alias("at"), F.lit(None).cast(unlike.select(F.struct(*kept)).schema[0].dataType).alias("row")))
        told = unlike.select(*ids, *[F.col(f"_ne_{i}_{j}") for i, j in pairs], F.explode(F.concat(F.array(itself), above)).alias("_t"))
        below = F.col("_t.row").isNull()
        met = told.groupBy(*ids, F.col("_t.at").alias("ptr")).agg(
            F.max("_t.row").alias("_row"), *[F.max(F.when(below, F.col(f"_ne_{i}_{j}"))).alias(f"_deep_{i}_{j}") for i, j in pairs]
        )
        unlike = met.where("_row IS NOT NULL").select(*ids, "ptr", "_row.*", *[f"_deep_{i}_{j}" for i, j in pairs])
        # Beneath a clash of types the trails differ; beneath an absence the parent is a stop.
        tail = F.array_contains("_kinds", "absent") & F.get("_trails", F.lit(0)).endswith("a")
        unlike = topmost(unlike, ids, (F.size("_kinds") > 1) | (F.size("_trails") > 1)).where((F.size("_trails") < 2) & ~tail)
    else:
        unlike = unlike.select("*", *[F.lit(False).alias(f"_deep_{i}_{j}") for i, j in pairs])
    length = (F.size("_kinds") == 1) & (F.get("_kinds", F.lit(0)) == "array")
    kind = (
        F.when(F.array_contains("_kinds", "absent"), "absent")
        .when(F.size("_kinds") > 1, "type")
        .when(length, "length")
        .otherwise("value")
    )
    mixed = F.size("_kinds") > 1
    equal = {
        (i, j): ~(F.col(f"_ne_{i}_{j}") | (mixed & F.coalesce(F.col(f"_deep_{i}_{j}"), F.lit(False)))) for i, j in pairs
    }
    group = _partition(sides, equal)
    found = unlike.withColumn("kind", kind).select("*", *[group[i].alias(f"_g{i}") for i in range(len(sides))])
    g = [F.col(f"_g{i}") for i in range(len(sides))]

    def shown(side: str) -> Column:
        v = F.col(side)
        return (
            F.when(v.isNull(), "<absent>")
            .when(v["jtype"] == "number", v["num"].cast("string"))
            .when(v["jtype"] == "string", F.concat(F.lit('"'), v["str"], F.lit('"')))
            .when(v["jtype"] == "boolean", v["bool"].cast("string"))
            .when(v["jtype"] == "null", "null")
            .otherwise(F.concat(v["jtype"], F.lit(" of "), v["size"].cast("string")))
        )

    typed = F.concat_ws(
        ",",
        *[
            F.when(
                F.col(f"has_{s}"),
                F.concat(F.lit(f"{s}="), F.when(F.col("kind") == "length", "number").otherwise(F.coalesce(F.col(s)["jtype"], F.lit("absent")))),
            )
            for s in sides
        ],
    )
    return (
        found.select(
            *ids,
            "ptr",
            "ord",
            "kind",
            partition_label(sides, g).alias("partition"),
            minority_sides(sides, g).alias("differing_sides"),
            typed.alias("value_types"),
            pointer_pattern(F.col("ptr")).alias("pattern"),
            F.concat_ws(
                "; ", *[F.when(F.col(f"has_{s}"), F.concat(F.lit(f"{s}="), preview(shown(s), max_chars))) for s in sides]
            ).alias("observed"),
        )
        .withColumn("shape", shape_key())
    )


def shape_key() -> Column:
    return F.concat_ws("::", "kind", "partition", "pattern", "value_types")


def cap_per_file(diffs: DataFrame, ids: Sequence[str], order: Sequence[Column], n: int) -> DataFrame:
    """The first ``n`` differences of each file; ``truncated`` only where the file has more.

    For ``n`` below a thousand at most ``n + 1`` rows per file leave each task before the shuffle
    (window group limit), so a file may hold any share of the rows.
    """
    files = Window.partitionBy(*ids)
    ranked = diffs.withColumn("_rn", F.row_number().over(files.orderBy(*order))).where(F.col("_rn") <= n + 1)
    return ranked.withColumn("truncated", F.max("_rn").over(files) > n).where(F.col("_rn") <= n).drop("_rn")


def group_shapes(diffs: DataFrame, file: str, n: int) -> DataFrame:
    """Disagreements by shape: occurrences, files, first ``n`` files, first occurrence."""
    by = ["shape", "kind", "partition", "value_types", "differing_sides", "pattern"]
    # Per (shape, file) first: a shape may hold any share of the rows.
    per_file = diffs.groupBy(*by, file).agg(
        F.count(F.lit(1)).alias("_n"), F.min(F.struct("ord", "ptr", "observed")).alias("_first")
    )
    groups = per_file.groupBy(*by).agg(
        F.sum("_n").alias("occurrences"),
        F.count(F.lit(1)).alias("file_count"),
        F.min(F.struct(F.col(file).alias("file"), "_first")).alias("_example"),
    )
    files = first_members(per_file, ["shape"], file, n, "files")
    return groups.join(files, "shape").select(
        *by,
        "occurrences",
        "file_count",
        "files",
        F.col("_example.file").alias("example_file"),
        F.col("_example._first.ptr").alias("example_ptr"),
        F.col("_example._first.observed").alias("example_observed"),
    )


def ordered_groups(groups: DataFrame) -> DataFrame:
    return groups.orderBy(F.desc("occurrences"), "shape")


def group_families(diffs: DataFrame, file: str, n: int) -> DataFrame:
    """Shapes rolled up over everything but the field; files are counted over the union."""
    by = ["kind", "partition", "value_types"]
    counts = diffs.groupBy(*by).agg(
        F.count(F.lit(1)).alias("occurrences"),
        F.countDistinct("shape").alias("shape_count"),
        F.countDistinct(file).alias("file_count"),
    )
    shapes = diffs.groupBy(*by, "shape", "pattern").agg(F.count(F.lit(1)).alias("_n"))
    ranked = shapes.withColumn(
        "_rn", F.row_number().over(Window.partitionBy(*by).orderBy(F.desc("_n"), "shape"))
    ).where(F.col("_rn") <= n)
    patterns = ranked.groupBy(*by).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("_rn", "pattern"))), lambda p: p["pattern"]).alias("pointer_patterns")
    )
    return counts.join(patterns, by).withColumn("family", F.concat_ws("::", *by))


# Fixed patterns of error grouping: an absolute path, a run of digits.
PATHS = r"(?:/[^\s'\"]+)+"
DIGITS = r"\d+"


def error_pattern(message: Column) -> Column:
    """A message without what makes two copies of one failure look different."""
    first = F.regexp_extract(F.regexp_replace(message, r"^\s+", ""), r"^[^\r\n]*", 0)
    shape = F.left(F.trim(F.regexp_replace(F.regexp_replace(first, PATHS, "<path>"), DIGITS, "#")), F.lit(300))
    return F.when(F.coalesce(F.regexp_replace(message, r"\s+", ""), F.lit("")) == "", "<no message>").otherwise(shape)


def group_outcomes(outcomes: DataFrame, file: str, n: int) -> DataFrame:
    """Failures by side and error shape: distinct files, first ``n`` files, first error."""
    failed = outcomes.where(~F.col("ok")).withColumn("error_pattern", error_pattern(F.col("error")))
    by = ["side", "error_pattern"]
    per_file = failed.groupBy(*by, file).agg(F.min("error").alias("error"))
    groups = per_file.groupBy(*by).agg(
        F.count(F.lit(1)).alias("file_count"), F.min(F.struct(F.col(file).alias("file"), "error")).alias("_example")
    )
    return groups.join(first_members(per_file, by, file, n, "files"), by).select(
        *by, "file_count", "files", F.col("_example.file").alias("example_file"), F.col("_example.error").alias("example_error")
    )


def sweep_totals(outcomes: DataFrame, diffs: DataFrame, ids: Sequence[str], sides: Sequence[str]) -> DataFrame:
    """One row of totals, with failures per side down to zero."""
    per_file = outcomes.groupBy(*ids).agg(
        F.min("ok").alias("_all_ok"),
        *[F.sum(((F.col("side") == s) & ~F.col("ok")).cast("long")).alias(f"_f_{s}") for s in sides],
    )
    with_diffs = diffs.groupBy(*ids).agg(F.count(F.lit(1)).alias("_n"))
    files = per_file.join(with_diffs, list(ids), "left").agg(
        F.count(F.lit(1)).alias("files_seen"),
        F.sum(F.col("_all_ok").cast("long")).alias("files_all_ok"),
        F.sum(F.col("_n").isNotNull().cast("long")).alias("files_with_differences"),
        F.sum(F.col("_n").isNull().cast("long")).alias("files_clean"),
        F.coalesce(F.sum("_n"), F.lit(0)).alias("differences_total"),
        *[F.sum(f"_f_{s}").alias(f"failures_{s}") for s in sides],
    )
    shapes = diffs.groupBy("shape", "kind", "partition", "value_types").agg(F.lit(1).alias("_one"))
    distinct = shapes.agg(
        F.count(F.lit(1)).alias("distinct_shapes"),
        F.countDistinct("kind", "partition", "value_types").alias("distinct_families"),
    )
    # Two rows, one per part, folded into one.
    both = files.unionByName(distinct, allowMissingColumns=True)
    return both.agg(*[F.max(c).alias(c) for c in both.columns])
