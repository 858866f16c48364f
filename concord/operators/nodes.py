"""Nested values as rows: the node table."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from concord.functions.json import pointer_token
from concord.functions.json_batch import plain_trees, slices
from concord.functions.json_text import FIELDS, NameHash, tree

# Fixed value: sorts keys the left side lacks, where it has no parent of them either, after all others.
AFTER_ALL = 2**63 - 1
# Values nested deeper make a text a reject.
MAX_DEPTH = 1_000
NODE = "ptr string, trail string, ord long, stop long, jtype string, size int, names long, num double, str string, bool boolean"
ARROW = {"string": pa.string(), "long": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_()}


def json_scan(df: DataFrame, ids: Sequence[str], json: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """One row per value of a JSON text, or one row with ``reject`` for what is no JSON.

    Every text is read once, from begin to end. ``ord`` is the offset at which a value begins, so sorting by it is document
    order; ``stop`` is where a container closes; ``trail`` has one letter per ancestor, ``o`` for an object and ``a`` for an
    array; ``names`` adds up the hashes of an object's member names. Rejected are null (``no text``), texts that break the
    grammar or end early, a name repeated in one object and values nested below ``max_depth``, with the offset in ``ord``.
    One scan, no shuffle; a task holds the values of some texts at a time, so a text should fit in memory. Texts are read a
    megabyte at once (``plain_trees``); those with a backslash, the longest and deepest and what is no JSON one by one.
    """
    kept = df.select(*ids, F.col(json).alias("_json"))
    kinds = [part.split() for part in NODE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = NameHash()
        for batch in batches:
            keys, fields = batch.columns[:-1], [*batch.schema.names[:-1], *[n for n, _ in kinds], "reject"]

            def rows(of: Sequence[int], columns: Sequence, reasons: Sequence[str | None]) -> pa.RecordBatch:
                at = pa.array(of, pa.int64())
                nodes = [pa.array(c, ARROW[kind]) if isinstance(c, list) else c.cast(ARROW[kind]) for c, (_, kind) in zip(columns, kinds)]
                return pa.RecordBatch.from_arrays([*[k.take(at) for k in keys], *nodes, pa.array(reasons, pa.string())], fields)

            for begin, end in slices(batch.columns[-1]):
                texts = batch.columns[-1].slice(begin, end - begin)
                at, columns, left = plain_trees(texts, max_depth, hashes)
                if len(at):
                    yield rows(begin + at, columns, pa.nulls(len(at), pa.string()))
                of: list[int] = []
                reasons: list[str | None] = []
                columns = [[] for _ in FIELDS]
                for i in left.tolist():
                    reason, offset = tree(texts[i].as_py(), max_depth, hashes, columns)
                    if reason is not None:
                        for name, column in zip(FIELDS, columns):
                            column.append(offset if name == "ord" else None)
                    fresh = len(columns[0]) - len(of)
                    of += [begin + i] * fresh
                    reasons += [reason] * fresh
                    if len(of) >= 50_000:
                        yield rows(of, columns, reasons)
                        of, reasons, columns = [], [], [[] for _ in FIELDS]
                if of:
                    yield rows(of, columns, reasons)

    names = StructType([kept.schema[c] for c in ids]).fields
    schema = StructType([*names, *StructType.fromDDL(NODE + ", reject string").fields])
    return kept.mapInArrow(run, schema)


def json_nodes(df: DataFrame, ids: Sequence[str], json: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """The values of ``json_scan``, with their depth."""
    return json_scan(df, ids, json, max_depth).where("reject IS NULL").select(
        *ids, "ptr", "trail", F.length("trail").alias("depth"), "ord", "stop", "jtype", "size", "names", "num", "str", "bool"
    )


def json_rejects(df: DataFrame, ids: Sequence[str], json: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """What ``json_scan`` rejects: ids, reason and offset."""
    return json_scan(df, ids, json, max_depth).where("reject IS NOT NULL").select(*ids, F.col("reject").alias("reason"), F.col("ord").alias("offset"))


# What a side says of one place.
VALUE = ("jtype", "size", "num", "str", "bool", "trail", "ord", "stop", "names")


def parent_of(ptr: Column) -> Column:
    """The pointer one step up; null at the root. (A slash inside a key is escaped.)"""
    return F.when(ptr != "", F.left(ptr, F.length(ptr) - F.length(F.substring_index(ptr, "/", -1)) - 1))


def align_sides(nodes: DataFrame, ids: Sequence[str], sides: Sequence[str], available: DataFrame | None = None) -> DataFrame:
    """One row per place with every side's value (null: absent) and which sides took part.

    ``available`` gives (ids, side) of the sides that produced the document at all; only
    documents with two or more of them are kept. Without it every side took part everywhere.
    """
    value = F.struct(*VALUE)
    # A place has a row a side: combining them before they move would sort all nodes for nothing.
    aligned = nodes.repartition(*ids, "ptr").groupBy(*ids, "ptr").agg(*[F.max(F.when(F.col("side") == s, value)).alias(s) for s in sides])
    if available is None:
        return aligned.select("*", *[F.lit(True).alias(f"has_{s}") for s in sides])
    has = available.groupBy(*ids).agg(*[F.max(F.col("side") == s).alias(f"has_{s}") for s in sides])
    enough = sum((F.col(f"has_{s}").cast("int") for s in sides), F.lit(0)) >= 2
    return aligned.join(has.where(enough), list(ids))


def topmost(rows: DataFrame, ids: Sequence[str], stop: Column, parent: tuple[Column, Column] | None = None) -> DataFrame:
    """Rows whose parent is no stop. (A stop deeper up has stops all the way down.)

    A stop also stands at the head of its own children; one window per parent then tells them.
    Only rows given here move, and they are read once. ``parent`` is (which rows tell their children, what): what a row's
    parent tells is added as ``_told``.
    """
    tells, what = parent or (F.lit(False), F.lit(None).cast("long"))
    group = F.array(
        F.struct(parent_of(F.col("ptr")).alias("of"), F.lit(True).alias("itself"), F.lit(False).alias("stop"), F.lit(None).cast("long").alias("what")),
        F.when(stop | tells, F.struct(F.col("ptr").alias("of"), F.lit(False).alias("itself"), stop.alias("stop"), what.alias("what"))),
    )
    placed = rows.withColumn("_g", F.explode(group)).where(F.col("_g").isNotNull())
    under = Window.partitionBy(*ids, "_g.of")
    known = placed.withColumn("_under", F.max("_g.stop").over(under))
    if parent is not None:
        known = known.withColumn("_told", F.max("_g.what").over(under))
    return known.where(F.col("_g.itself") & ~F.col("_under")).drop("_g", "_under")


def record_nodes(df: DataFrame, ids: Sequence[str], path: Column, fields: Mapping[str, Column]) -> DataFrame:
    """Flat records as leaf nodes: one row per field, pointer ``<path>/<field>``.

    The JSON type follows the column's own type. A field whose column is null is absent.
    """
    types = df.select(*[c.alias(n) for n, c in fields.items()]).schema
    cells = []
    for at, (name, column) in enumerate(fields.items()):
        kind = types[name].dataType.typeName()
        jtype = "string" if kind == "string" else "boolean" if kind == "boolean" else "number"
        cells.append(
            F.when(
                column.isNotNull(),
                F.struct(
                    F.lit(name).alias("field"),
                    F.lit(at).alias("at"),
                    F.lit(jtype).alias("jtype"),
                    (column.cast("double") if jtype == "number" else F.lit(None).cast("double")).alias("num"),
                    (column if jtype == "string" else F.lit(None).cast("string")).alias("str"),
                    (column if jtype == "boolean" else F.lit(None).cast("boolean")).alias("bool"),
                ),
            )
        )
    exploded = df.select(*ids, path.alias("_path"), F.explode(F.filter(F.array(*cells), lambda c: c.isNotNull())).alias("_c"))
    return exploded.select(
        *ids,
        F.concat("_path", F.lit("/"), pointer_token(F.col("_c.field"))).alias("ptr"),
        F.lit("o").alias("trail"),
        F.col("_c.at").cast("long").alias("ord"),
        F.lit(None).cast("long").alias("stop"),
        F.col("_c.jtype").alias("jtype"),
        F.lit(None).cast("int").alias("size"),
        F.lit(None).cast("long").alias("names"),
        F.col("_c.num").alias("num"),
        F.col("_c.str").alias("str"),
        F.col("_c.bool").alias("bool"),
    )
