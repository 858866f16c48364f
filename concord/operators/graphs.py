"""Directed graphs as edge tables: strongly connected parts and layers, with chains contracted by doubling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.operators.skew import spread_join
from concord.session import durable


def _ends(edges: DataFrame) -> DataFrame:
    """Edges whose start is reached and whose end leads on: one step of peeling from both sides."""
    srcs, dsts = edges.select("cs").distinct(), edges.select("cd").distinct()
    onward = spread_join(edges, srcs.withColumnRenamed("cs", "cd"), ["cd"], "left_semi")
    return spread_join(onward, dsts.withColumnRenamed("cd", "cs"), ["cs"], "left_semi")


def _chains(edges: DataFrame) -> tuple[DataFrame, int]:
    """(node, last, next, top, ring) of nodes with one edge in and one out, and their number.

    ``last`` is the end of the node's chain, ``next`` what follows it, ``top`` the largest node from it to there. Each
    step doubles what a row covers; what is still open when that exceeds the number of nodes is a ring.
    """
    out = edges.groupBy(F.col("cs").alias("node")).agg(F.count(F.lit(1)).alias("_o"), F.min("cd").alias("next")).where("_o = 1")
    into = edges.groupBy(F.col("cd").alias("node")).agg(F.count(F.lit(1)).alias("_i")).where("_i = 1")
    rows = durable(out.join(into, "node").select("node", F.col("node").alias("last"), "next", F.col("node").alias("top")))
    n, covered = rows.count(), 1
    while True:
        joined = rows.alias("a").join(rows.alias("b"), F.col("a.next") == F.col("b.node"), "left")
        open_ = F.col("b.node").isNotNull()
        if covered >= n:
            return durable(joined.select("a.*", open_.alias("ring"))), n
        longer = joined.select(
            "a.node", F.coalesce("b.last", "a.last").alias("last"), F.coalesce("b.next", "a.next").alias("next"),
            F.greatest("a.top", "b.top").alias("top"), open_.alias("_open"),
        )
        longer = durable(longer)
        rows, covered = longer.drop("_open"), covered * 2
        if longer.where("_open").isEmpty():
            return rows.withColumn("ring", F.lit(False)), n


def _contract(edges: DataFrame) -> tuple[DataFrame, int]:
    """(cs, cd, ns, nd, ring): the edge that stands for each edge once every chain is one edge; ``ring`` names a ring by its largest node."""
    chains, n = _chains(edges)
    if not n:
        return edges.select("cs", "cd", F.col("cs").alias("ns"), F.col("cd").alias("nd"), F.when(F.lit(False), F.col("cs")).alias("ring")), 0
    start = chains.select(F.col("node").alias("cs"), F.col("last").alias("_last"), F.when(F.col("ring"), F.col("top")).alias("ring"), F.lit(True).alias("_in"))
    end = chains.select(F.col("node").alias("cd"), F.col("last").alias("_to"), "next")
    met = durable(spread_join(spread_join(edges, start, ["cs"]), end, ["cd"]).withColumn("_via", F.coalesce("_to", "_last")))
    heads = met.where("_in IS NULL AND _to IS NOT NULL").select("_via", F.col("cs").alias("_head"))
    moved = spread_join(met, heads, ["_via"])
    return moved.select("cs", "cd", F.when(F.col("_in"), F.col("_head")).otherwise(F.col("cs")).alias("ns"), F.coalesce("next", "cd").alias("nd"), "ring"), n


def _coloured(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, colour) of nodes that reach back to the node their colour is named after, the largest that reaches them; and the edges between others."""
    colours = durable(edges.select(F.col("cs").alias("node")).union(edges.select("cd")).distinct().withColumn("colour", F.col("node")))
    while True:
        sent = edges.join(colours, edges["cs"] == colours["node"]).select(F.col("cd").alias("node"), F.col("colour").alias("_sent"))
        best = sent.groupBy("node").agg(F.max("_sent").alias("_sent"))
        moved = colours.join(best, "node", "left").select("node", F.greatest("colour", "_sent").alias("colour"), (F.col("_sent") > F.col("colour")).alias("_moved"))
        moved = durable(moved)
        colours = moved.select("node", "colour")
        if moved.where("_moved").isEmpty():
            break
    inside = edges.join(colours.select(F.col("node").alias("cs"), "colour"), "cs").join(colours.select(F.col("node").alias("cd"), F.col("colour").alias("_b")), "cd")
    inside = durable(inside.where("colour = _b").select("cs", "cd", "colour"))
    members = frontier = durable(colours.where("node = colour"))
    while True:
        back = inside.join(frontier.select(F.col("node").alias("cd"), "colour"), ["cd", "colour"]).select(F.col("cs").alias("node"), "colour").distinct()
        frontier = durable(back.join(members, ["node", "colour"], "left_anti"))
        if frontier.isEmpty():
            break
        members = durable(members.unionByName(frontier))
    gone = members.select("node")
    rest = edges.join(gone.withColumnRenamed("node", "cs"), "cs", "left_anti").join(gone.withColumnRenamed("node", "cd"), "cd", "left_anti")
    return members, durable(rest)


def cyclic_edges(edges: DataFrame) -> DataFrame:
    """(src, dst, part): the edges that lie on a cycle, with a name for the strongly connected part they are in.

    Each round peels the ends and contracts every chain of nodes with one edge in and one out to a single edge, so trees
    and chains go in rounds logarithmic in their size and a ring of any length is found by doubling. ``origin`` keeps which
    present edge stands for each edge given. An edge that comes back to its own node closes a cycle there and waits for that
    node's part. What neither peels nor contracts is coloured: the largest node that reaches a node colours it, and nodes
    that reach back form a part. That takes rounds by the width of the contracted graph, not by the lengths of its chains.
    Edges with a null end are left out; repeated edges count once. Each step is written out.
    """
    origin = durable(edges.select("src", "dst").where("src IS NOT NULL AND dst IS NOT NULL").distinct().selectExpr("src", "dst", "src AS cs", "dst AS cd"))
    named, loops = origin.where("cs = cd").select("src", "dst", F.col("cs").alias("part")).limit(0), []

    def split(rows: DataFrame) -> DataFrame:
        loops.append(rows.where("cs = cd").select("src", "dst", F.col("cs").alias("at")))
        return rows.where("cs <> cd")

    origin = split(origin)
    while not origin.isEmpty():
        present = durable(origin.select("cs", "cd").distinct())
        before = present.count()
        kept = durable(_ends(present))
        mapped, n = _contract(kept)
        if n or kept.count() < before:
            moved = durable(spread_join(origin, mapped, ["cs", "cd"], "inner").select("src", "dst", F.col("ns").alias("cs"), F.col("nd").alias("cd"), "ring"))
            named = named.unionByName(moved.where("ring IS NOT NULL").select("src", "dst", F.col("ring").alias("part")))
            origin = split(moved.where("ring IS NULL").drop("ring"))
            continue
        members, rest = _coloured(kept)
        ends = lambda c, colour: members.select(F.col("node").alias(c), F.col("colour").alias(colour))
        inside = origin.join(ends("cs", "part"), "cs").join(ends("cd", "_b"), "cd").where("part = _b").select("src", "dst", "part")
        named = named.unionByName(durable(inside))
        origin = durable(spread_join(origin, rest.select("cs", "cd").distinct(), ["cs", "cd"], "left_semi"))
    # A node that later fell into a part gives it to the loops that were closed at it.
    for closed in reversed(loops):
        if not closed.isEmpty():
            part = named.groupBy(F.col("src").alias("at")).agg(F.max("part").alias("part"))
            named = durable(named.unionByName(spread_join(closed, part, ["at"]).select("src", "dst", F.coalesce("part", "at").alias("part"))))
    return named


def cycles(edges: DataFrame) -> DataFrame:
    """Every node on a cycle, with the cycle's component (its largest node). See ``cyclic_edges``."""
    nodes = durable(cyclic_edges(edges).groupBy(F.col("src").alias("node")).agg(F.max("part").alias("part")))
    return spread_join(nodes, nodes.groupBy("part").agg(F.max("node").alias("component")), ["part"]).select("node", "component")


def layers(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, wave): 1 for a node without edges, else one more than the largest wave among the nodes its edges lead to.

    A node with one edge left has the wave max(a, wave of the end + w). Such functions compose, so whole trees and chains
    of them are followed to their end by doubling; edges to them then lead to that end, with its length. A round takes
    out every node with at most one edge, and edges that become equal fold. Rounds grow with how often paths part and
    meet again one after the other. Edges to or from what is no member do not count; a cycle is an error.
    """
    members = durable(nodes.select("node").where("node IS NOT NULL").distinct())
    inside = spread_join(edges.select("src", "dst").distinct(), members.withColumnRenamed("node", "src"), ["src"], "left_semi")
    inside = durable(spread_join(inside, members.withColumnRenamed("node", "dst"), ["dst"], "left_semi").withColumn("w", F.lit(1).cast("long")))
    left = members.withColumn("floor", F.lit(1).cast("long"))
    placed, hung = left.select("node", F.col("floor").alias("wave")).limit(0), []
    while not left.isEmpty():
        out = inside.groupBy(F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("_n"), F.max("dst").alias("up"), F.max("w").alias("w"))
        sorted_ = durable(left.join(out, "node", "left"))
        free = sorted_.where("_n IS NULL").select("node", F.col("floor").alias("wave"))
        if free.isEmpty():
            raise ValueError(f"no order: {left.count()} members wait on a cycle")
        single = durable(sorted_.where("_n = 1").select("node", "up", F.col("floor").alias("a"), "w"))
        n, covered, open_ = single.count(), 1, True
        while open_ and n:
            joined = single.alias("x").join(single.alias("y"), F.col("x.up") == F.col("y.node"), "left")
            longer = joined.select(
                "x.node", F.coalesce("y.up", "x.up").alias("up"), F.greatest("x.a", F.col("y.a") + F.col("x.w")).alias("a"),
                (F.col("x.w") + F.coalesce("y.w", F.lit(0))).alias("w"), F.col("y.node").isNotNull().alias("_open"),
            )
            longer = durable(longer)
            open_, single = not longer.where("_open").isEmpty(), longer.drop("_open")
            if open_ and covered > n:
                raise ValueError(f"no order: {left.count()} members wait on a cycle")
            covered *= 2
        ends = spread_join(single, free.select(F.col("node").alias("up"), "wave"), ["up"])
        ends = durable(ends.select("node", "up", "a", "w", F.greatest("a", F.col("wave") + F.col("w")).alias("wave"), F.col("wave").isNotNull().alias("_known")))
        known = durable(free.unionByName(ends.where("_known").select("node", "wave")))
        placed = placed.unionByName(known)
        hung.append(ends.where("NOT _known").select("node", "up", "a", "w"))
        # Edges of the rest: to a known node they are a bound, to a single one they lead on to its end.
        branched = sorted_.where("_n > 1").select("node", "floor")
        rest = spread_join(inside, branched.select(F.col("node").alias("src")), ["src"], "left_semi")
        rest = spread_join(rest, known.select(F.col("node").alias("dst"), "wave"), ["dst"])
        rest = spread_join(rest, hung[-1].select(F.col("node").alias("dst"), "up", "a", F.col("w").alias("_w")), ["dst"])
        rest = durable(rest.select("src", F.coalesce("up", "dst").alias("dst"), (F.col("w") + F.coalesce("_w", F.lit(0))).alias("w"), (F.coalesce("wave", "a") + F.col("w")).alias("bound"), "wave"))
        bounds = rest.groupBy(F.col("src").alias("node")).agg(F.max("bound").alias("_b"))
        left = durable(branched.join(bounds, "node", "left").select("node", F.greatest("floor", "_b").alias("floor")))
        inside = durable(rest.where("wave IS NULL").groupBy("src", "dst").agg(F.max("w").alias("w")))
    for waiting in reversed(hung):
        if not waiting.isEmpty():
            end = spread_join(waiting, placed.select(F.col("node").alias("up"), "wave"), ["up"], "inner")
            placed = durable(placed.unionByName(end.select("node", F.greatest("a", F.col("wave") + F.col("w")).alias("wave"))))
    return placed.select("node", F.col("wave").cast("int").alias("wave"))
