"""Near-duplicates: bottom-k sketches of one hash function, inverted lists, union-sketch estimates, exact Jaccard."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import WordHash, batch_of, durable, mix, sliced, text_bytes, windows, written
from concord.llm.components import components

WIDTH, SKETCH, FINE = 5, 128, 1_024
#: Lists of so many nodes are compared pair by pair, longer ones in blocks of BLOCK nodes, COLUMNS values at a time.
SHORT_LIST, BLOCK, COLUMNS = 16, 512, 4_096
#: Texts are picked by a broadcast of their ids up to so many (8 bytes each), by a shuffled join beyond.
BROADCAST_IDS = 1_000_000


def shingles(text: bytes | None, hashes: WordHash, width: int = WIDTH) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's word runs: runs of ``width``, or all words if there are fewer."""
    words = text.lower().split() if text else []  # bytes: only A-Z change, only ASCII white space parts
    if not words:
        return np.empty(0, np.uint64)
    return np.unique(windows(hashes.of(words), min(width, len(words))))


def least_overlap(n: int, k: int, percent: int, deviations: float) -> int:
    """How many retained values a linked partner shares at least, for a set of ``n``.

    Where every partner is retained whole, the exact bound. Otherwise the estimate is the share of a sample drawn without
    return from the union, of at most n / t values; it may fall short of t by so many standard deviations.
    """
    kept, t = min(n, k), percent / 100
    missing = max(0.0, 1 - k * t / max(n, 1))
    share = t - deviations * np.sqrt(t * (1 - t) / max(kept, 1) * missing)
    return max(1, int(np.ceil(kept * share - 1e-9)))


def sketched(docs: DataFrame, width: int, k: int, percent: int, deviations: float, id_col: str, text_col: str) -> DataFrame:
    """(doc_id, n, key1, key2, sketch, least): set size, two keys of the whole set, the k least hashes, and ``least_overlap``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches):
            sets = [shingles(t, hashes, width) for t in text_bytes(batch.column(1))]
            signed = lambda f: pa.array([int(f(s).sum(dtype=np.uint64).astype(np.int64)) for s in sets], pa.int64())
            n = [len(s) for s in sets]
            yield batch_of(
                doc_id=batch.column(0), n=pa.array(n, pa.int64()), key1=signed(lambda s: s), key2=signed(lambda s: mix(s ^ np.uint64(0x5851F42D4C957F2D))),
                sketch=pa.array([s[:k].view(np.int64) for s in sets], pa.list_(pa.int64())), least=pa.array([least_overlap(x, k, percent, deviations) for x in n], pa.int32()),
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, n long, key1 long, key2 long, sketch array<long>, least int")


def index_lists(nodes: DataFrame) -> DataFrame:
    """(value, node, n, place, size, least) of the retained values that can lead to a partner.

    Values are ordered the rarest first, and two sketches that share ``least`` values share one among the first
    size - least + 1 of either. Values of one sketch only lead nowhere and come before all others, so a document whose
    values are mostly its own drops out, however common a passage it holds.
    """
    size = F.size("sketch")
    values = nodes.select("node", "n", size.alias("size"), "least", F.explode("sketch").alias("value"))
    shared = values.groupBy("value").agg(F.count("*").alias("df")).where("df > 1")
    met = values.join(shared, "value")
    by_node = Window.partitionBy("node")
    place = F.col("size") - F.count("*").over(by_node) + F.row_number().over(by_node.orderBy("df", "value"))
    met = met.withColumn("place", place.cast("int")).where(F.col("place") <= F.col("size") - F.col("least") + 1)
    return met.select("value", "node", "n", "place", "size", "least")


def stars(lists: DataFrame) -> DataFrame:
    """Pairs (a, b): each node with the centre of most of its lists and with the centre of its rarest.

    The centre of a list is the node with the fewest rarer values: in a group of near copies, the one nearest to all.
    """
    centres = lists.groupBy("value").agg(F.min(F.struct("place", "node")).alias("centre")).select("value", F.col("centre.node").alias("centre"))
    met = lists.join(centres, "value").where("node <> centre")
    votes = met.groupBy("node", "centre").agg(F.count("*").alias("votes"), F.min("place").alias("place"))
    best = votes.groupBy("node").agg(F.max(F.struct("votes", "centre")).alias("most"), F.min(F.struct("place", "centre")).alias("rarest"))
    return best.select(F.col("node").alias("a"), F.explode(F.array("most.centre", "rarest.centre")).alias("b")).distinct()


def labelled(lists: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``lists`` with each node's root, of the lists that hold several roots; and those lists: (value, main, held)."""
    rows = lists.join(found, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = rows.groupBy("value", "root").agg(F.count("*").alias("held"))
    several = held.groupBy("value").agg(F.max(F.struct("held", "root")).alias("main"), F.count("*").alias("roots"), F.sum("held").alias("members")).where("roots > 1")
    several = several.select("value", F.col("main.root").alias("main"), "members")
    return rows.join(several, "value"), several


def in_short_lists(mixed: DataFrame, percent: int) -> DataFrame:
    """Pairs of short lists: nodes outside a list's largest component with its other nodes, if size and place allow a link."""
    short = mixed.where(F.col("members") <= SHORT_LIST)
    one, two = short.where("root <> main").alias("x"), short.alias("y")
    shared = F.least(F.col("x.size") - F.col("x.place"), F.col("y.size") - F.col("y.place")) + 1
    possible = (
        (F.col("x.value") == F.col("y.value")) & (F.col("x.root") != F.col("y.root"))
        # both outside the main component: once is enough
        & ((F.col("y.root") == F.col("y.main")) | (F.col("x.node") < F.col("y.node")))
        & (100 * F.least("x.n", "y.n") >= percent * F.greatest("x.n", "y.n")) & (shared >= F.greatest("x.least", "y.least"))
        & ((F.col("x.size") < F.col("x.n")) | (F.col("y.size") < F.col("y.n")) | (shared * (100 + percent) >= percent * (F.col("x.n") + F.col("y.n"))))
    )
    return one.join(two, possible).select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def in_long_lists(mixed: DataFrame, nodes: DataFrame, k: int, percent: int, deviations: float) -> DataFrame:
    """Likely pairs of long lists. Lists that share nodes are one cluster; its nodes outside the largest component meet all its nodes
    in blocks of BLOCK by BLOCK sketches, each its own task's work, and only pairs that pass the estimate come out."""
    long = mixed.where(F.col("members") > SHORT_LIST)
    centres = long.groupBy("value").agg(F.min("node").alias("b"))
    links = long.join(centres, "value").select(F.col("node").alias("a"), "b").distinct()
    clusters = components(links).select("node", F.col("root").alias("cluster"))
    # A node that is alone in its long lists has no partner there.
    members = durable(clusters.join(long.select("node", "root").distinct(), "node"))
    held = members.groupBy("cluster", "root").agg(F.count("*").alias("held"))
    whole = held.groupBy("cluster").agg(F.max(F.struct("held", "root")).alias("main"), F.sum("held").alias("all")).where(F.col("main.held") < F.col("all"))
    blocks = lambda c: F.ceil(c / BLOCK).cast("int")
    whole = whole.select("cluster", F.col("main.root").alias("main"), blocks(F.col("all") - F.col("main.held")).alias("rows"), blocks(F.col("all")).alias("columns"))
    full = members.join(whole, "cluster").join(nodes.select("node", "n", "sketch", "least"), "node")
    cell = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    kept = ["cluster", "node", "root", "n", "sketch", "least"]
    one = full.where("root <> main").select(*kept, cell(F.col("rows")).alias("i"), all_of(F.col("columns")).alias("j"), F.lit(True).alias("outside"))
    two = full.select(*kept, all_of(F.col("rows")).alias("i"), cell(F.col("columns")).alias("j"), F.lit(False).alias("outside"))

    def meet(table: pa.Table) -> pa.Table:
        outside = table.column("outside").to_numpy()
        node, root, n, least = (table.column(c).to_numpy() for c in ("node", "root", "n", "least"))
        lists = table.column("sketch").combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        row, flat = np.repeat(np.arange(len(size)), size), lists.flatten().to_numpy()
        values, column, count = np.unique(flat, return_inverse=True, return_counts=True)
        shared = count[column] > 1
        row, column = row[shared], (np.cumsum(count > 1) - 1)[column[shared]]
        x, y = np.flatnonzero(outside), np.flatnonzero(~outside)
        at = np.empty(len(size), np.int64)
        at[x], at[y] = np.arange(len(x)), np.arange(len(y))
        overlap = np.zeros((len(x), len(y)), np.float32)
        order = np.argsort(column, kind="stable")
        row, column = row[order], column[order]
        for low in range(0, int(column[-1]) + 1 if len(column) else 0, COLUMNS):
            a, b = np.searchsorted(column, [low, low + COLUMNS])
            r, c = row[a:b], column[a:b] - low
            left, right = np.zeros((len(x), COLUMNS), np.float32), np.zeros((len(y), COLUMNS), np.float32)
            left[at[r[outside[r]]], c[outside[r]]] = 1
            right[at[r[~outside[r]]], c[~outside[r]]] = 1
            overlap += left @ right.T
        need = np.maximum(least[x][:, None], least[y][None])
        pair, more, less = n[x][:, None] + n[y][None], np.maximum(n[x][:, None], n[y][None]), np.minimum(n[x][:, None], n[y][None])
        need = np.where(more <= k, -(-percent * pair // (100 + percent)), need)  # both whole
        i, j = np.nonzero((overlap >= need) & (100 * less >= percent * more) & (root[x][:, None] != root[y][None]))
        start = lists.offsets.to_numpy()
        start = start - start[0]
        cut = lambda t: flat[start[t] : start[t + 1]].view(np.uint64)
        good = [(p, q) for p, q in zip(x[i].tolist(), y[j].tolist()) if may_link(cut(p), cut(q), n[p], n[q], k, percent, deviations)]
        p, q = (np.array([g[side] for g in good], np.int64) for side in (0, 1))
        return pa.table({"a": np.minimum(node[p], node[q]), "b": np.maximum(node[p], node[q])})

    kind = mixed.schema["node"].dataType.simpleString()
    return one.unionByName(two).groupBy("cluster", "i", "j").applyInArrow(meet, f"a {kind}, b {kind}").distinct()


def may_link(x: np.ndarray, y: np.ndarray, n: int, m: int, k: int, percent: int, deviations: float) -> bool:
    """Whether sketches of sets of ``n`` and ``m`` values allow the similarity: the share of the union's k least values that are
    in both, or all of them where both sets are retained whole."""
    t = percent / 100
    both = np.intersect1d(x, y, assume_unique=True)
    if n <= k and m <= k:
        return len(both) > 0 and 100 * len(both) >= percent * (n + m - len(both))
    union = np.union1d(x, y)[:k]
    shared = int(np.searchsorted(both, union[-1], "right"))
    missing = max(0.0, 1 - len(union) * (1 + t) / (n + m))
    return shared >= len(union) * (t - deviations * np.sqrt(t * (1 - t) / len(union) * missing)) - 1e-9


def picked(texts: DataFrame, ids: DataFrame, id_col: str) -> DataFrame:
    """The rows of ``texts`` whose id is in ``ids`` (one column, distinct)."""
    few = F.broadcast(ids) if ids.count() <= BROADCAST_IDS else ids
    return texts.join(few, id_col, "left_semi")


def verified(docs: DataFrame, pairs: DataFrame, width: int, percent: int, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets have a Jaccard similarity of ``percent`` or more. Only texts of pairs move.

    ``pairs`` are read three times, for their ids and for either text: what is costly to find should be ``durable``."""
    ids = durable(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    texts = picked(docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), ids, "id")
    rows = pairs.join(texts.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    rows = rows.join(texts.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b").select("a", "b", "text_a", "text_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        last: tuple[bytes | None, np.ndarray] = (None, np.empty(0, np.uint64))
        for batch in sliced(batches):
            linked = []
            for x, y in zip(text_bytes(batch.column(2)), text_bytes(batch.column(3))):
                if last[0] != y:  # rows come in order of b
                    last = (y, shingles(y, hashes, width))
                one = shingles(x, hashes, width)
                both = len(np.intersect1d(one, last[1], assume_unique=True))
                linked.append(both > 0 and 100 * both >= percent * (len(one) + len(last[1]) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(linked, pa.bool_()))

    kind = docs.schema[id_col].dataType.simpleString()
    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def estimated(pairs: DataFrame, nodes: DataFrame, k: int, percent: int, deviations: float) -> DataFrame:
    """The pairs whose union sketch allows the link."""
    rows = pairs.join(nodes.select(F.col("node").alias("a"), F.col("sketch").alias("one"), F.col("n").alias("n_a")), "a")
    rows = rows.join(nodes.select(F.col("node").alias("b"), F.col("sketch").alias("two"), F.col("n").alias("n_b")), "b")
    rows = rows.select("a", "b", "one", "two", "n_a", "n_b")
    kind = pairs.schema["a"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            sizes = zip(batch.column(4).to_pylist(), batch.column(5).to_pylist())
            sketches = zip(batch.column(2), batch.column(3))
            value = lambda x: x.values.to_numpy().view(np.uint64)
            keep = [may_link(value(x), value(y), n, m, k, percent, deviations) for (x, y), (n, m) in zip(sketches, sizes)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, f"a {kind}, b {kind}")


def near_duplicates(
    docs: DataFrame, percent: int = 75, width: int = WIDTH, k: int = SKETCH, fine: int = FINE, deviations: float = 4.7, id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of every row of ``docs``.

    1. Each text's set of shingles is hashed by one function; the k least hashes are its sketch. Texts of equal sets are
       one class with the least id as its node (two keys of the whole set, 128 bits, and its size).
    2. Inverted lists of retained values, rarest values first (``index_lists``).
    3. Every node is compared with the centres of its lists (``stars``). That joins most of a group of copies, however
       large, in about as many pairs as nodes.
    4. Nodes of lists that still hold several components get a sketch of ``fine`` values, and lists of those; in them a
       document reaches a common value only if it is mostly made of values as common. Stars again.
    5. In lists that hold several components even now, the nodes outside the largest meet the others: in short lists as
       pairs, in long ones in blocks of sketches. Union-sketch estimates filter, exact Jaccard over whole sets confirms.
       No pair is capped; links inside one component add nothing and are not made.
    6. Components of the links; ids follow their class.

    Sets are compared as sets of 64-bit hashes. A link is missed only if an estimate falls short of its similarity by more
    than ``deviations`` standard deviations: about 1 in 700,000 for a link at the threshold itself, never where both sets
    have less than three quarters of k values. Hot values move as counts, or as keys of sort-merge joins, which adaptive
    execution splits.

    Null, empty and wordless texts have an empty set and are linked with nothing. Rows without id are linked with
    nothing, have no component and are kept. Rows that repeat an id share its node: it is linked if any of their texts is. Other
    columns are not read. An empty table gives an empty table.
    """
    rows = written(sketched(docs, width, k, percent, deviations, id_col, text_col))
    key = ["n", "key1", "key2"]
    known = F.col("doc_id").isNotNull() & (F.col("n") > 0)
    classes = durable(rows.where(known).groupBy(*key).agg(F.min("doc_id").alias("node")))
    named = classes.select("node", *[F.col(c).alias(f"c_{c}") for c in key])
    equal = (F.col("n") == F.col("c_n")) & (F.col("key1") == F.col("c_key1")) & (F.col("key2") == F.col("c_key2"))
    firsts = rows.where(known).join(named, equal & (F.col("doc_id") == F.col("node")), "left_semi")
    lists = written(index_lists(firsts.select(F.col("doc_id").alias("node"), "n", "sketch", "least")))
    found = components(verified(docs, durable(stars(lists)), width, percent, id_col, text_col))

    mixed, _ = labelled(lists, found)
    open_nodes = durable(mixed.select("node").distinct())
    texts = picked(docs.select(F.col(id_col).alias("node"), F.col(text_col).alias("text")), open_nodes, "node")
    nodes = written(sketched(texts, width, fine, percent, deviations, "node", "text").select(F.col("doc_id").alias("node"), "n", "sketch", "least"))
    lists = written(index_lists(nodes))
    mixed, _ = labelled(lists, found)
    likely = durable(estimated(stars(mixed.select(*lists.columns)), nodes, fine, percent, deviations))
    found = components(verified(docs, likely, width, percent, id_col, text_col), found)

    mixed = written(labelled(lists, found)[0].select("value", "node", "root", "n", "place", "size", "least", "main", "members"))
    likely = durable(estimated(in_short_lists(mixed, percent), nodes, fine, percent, deviations).unionByName(in_long_lists(mixed, nodes, fine, percent, deviations)).distinct())
    found = components(verified(docs, likely, width, percent, id_col, text_col), found)

    by_key = named.join(found.select("node", F.col("root").alias("component")), "node", "left").select("c_n", "c_key1", "c_key2", F.coalesce("component", "node").alias("component"))
    component = F.coalesce("component", "doc_id")
    return rows.join(by_key, known & equal, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(True)).alias("kept"),
    )
