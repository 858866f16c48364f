"""Substring dedup: word k-mers as edges of a de Bruijn graph, repeated paths compacted, source coordinates verified."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import WordHash, batch_of, mix, sliced, text_bytes, windows, written

#: Edges sorted at once by a task that reads texts, and edges that one group of equal hash ranges is meant to hold.
BLOCK_EDGES, BUCKET_EDGES = 500_000, 1_000_000
#: Texts are picked by a broadcast of their ids up to so many (8 bytes each), by a shuffled join beyond.
BROADCAST_IDS = 1_000_000


def packed(*arrays: np.ndarray) -> bytes:
    """Equally long 64-bit arrays, byte by byte of all values, compressed."""
    import zstandard

    planes = [np.ascontiguousarray(a.astype(np.int64)).view(np.uint8).reshape(-1, 8).T.tobytes() for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def unpacked(body: bytes, count: int) -> list[np.ndarray]:
    import zstandard

    flat = np.frombuffer(zstandard.ZstdDecompressor().decompress(body), np.uint8).reshape(count, 8, -1)
    return [np.ascontiguousarray(planes.T).view(np.int64).reshape(-1) for planes in flat]


def edges(text: bytes | None, hashes: WordHash, k: int) -> np.ndarray:
    """56-bit hashes of a text's k-mers, in order."""
    return windows(hashes.of(text.split()), k) >> np.uint64(8) if text else np.empty(0, np.uint64)


def spread(key: np.ndarray, n: int) -> np.ndarray:
    """Numbers below ``n`` of 64-bit keys."""
    return ((mix(key.astype(np.uint64)) >> np.uint64(32)) * np.uint64(n) >> np.uint64(32)).astype(np.int64)


def cells(number: np.ndarray, kind: int, arrays: list[np.ndarray]) -> Iterator[tuple[int, int, bytes]]:
    """(number, kind, body) of each stretch of equal ``number``, which is in order. The first array of kind 0, in order, is packed as steps."""
    if len(number):
        cut = np.concatenate([[0], np.flatnonzero(np.diff(number)) + 1, [len(number)]])
        for a, b in zip(cut, cut[1:]):
            part = [x[a:b] for x in arrays]
            if kind == 0:
                part[0] = np.diff(part[0], prepend=part[0].dtype.type(0))
            yield int(number[a]), kind, packed(*part)


def block_cells(h: np.ndarray, doc: np.ndarray, at: np.ndarray, buckets: int, homes: int) -> Iterator[tuple[int, int, bytes]]:
    """Cells of one block of edges: for each distinct edge its first occurrence, and for later documents where they have it from.

    However often an edge occurs in a block, one occurrence goes on to meet those of other blocks.
    """
    order = np.argsort(h, kind="stable")
    h, doc, at = h[order], doc[order], at[order]
    new = np.concatenate([[True], h[1:] != h[:-1]])
    many = ~(new & np.concatenate([new[1:], [True]]))
    by = np.flatnonzero(many)
    inner = by[np.lexsort((at[by], doc[by], h[by]))]  # of equal edges the least document comes first, at its first place
    doc[by], at[by] = doc[inner], at[inner]
    owner = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
    later = doc > doc[owner]
    bucket = ((h >> np.uint64(24)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
    first = np.flatnonzero(new)
    yield from cells(bucket[first], 0, [h[first].astype(np.int64), doc[first], at[first]])
    # A later document's own first place of the edge is enough: the others are found in its text.
    again = np.concatenate([[False], (h[1:] == h[:-1]) & (doc[1:] == doc[:-1])])
    yield from found_cells(doc, at, doc[owner], at[owner], later & ~again, homes)


def found_cells(doc: np.ndarray, at: np.ndarray, source: np.ndarray, source_at: np.ndarray, pick: np.ndarray, homes: int) -> Iterator[tuple[int, int, bytes]]:
    rows = np.flatnonzero(pick)
    home = spread(doc[rows], homes)
    by = np.lexsort((at[rows], doc[rows], home))
    rows = rows[by]
    yield from cells(home[by], 1, [doc[rows], at[rows], source[rows], source_at[rows]])


def repeated_edges(docs: DataFrame, k: int, buckets: int) -> DataFrame:
    """(home, body): packed (document, place, source document, source place) of edges that a smaller document has too."""

    def emit(found: list[tuple[int, int, bytes]], name: str) -> Iterator[pa.RecordBatch]:
        for i in range(0, len(found), 256):
            number, kind, body = zip(*found[i : i + 256])
            yield batch_of(**{name: pa.array(number, pa.int64()), "kind": pa.array(kind, pa.int32()), "body": pa.array(body, pa.binary())})

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, parts = WordHash(), 0, []

        def done() -> Iterator[pa.RecordBatch]:
            h, doc, at = (np.concatenate(x) for x in zip(*parts))
            out = [(n if kind == 0 else n % buckets, kind, body if kind == 0 else n.to_bytes(8, "big") + body) for n, kind, body in block_cells(h, doc, at, buckets, buckets)]
            yield from emit(out, "bucket")

        for batch in sliced(batches):
            for i, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                h = edges(text, hashes, k)
                if len(h):
                    parts.append((h, np.full(len(h), i, np.int64), np.arange(len(h), dtype=np.int64)))
                    held += len(h)
                if held >= BLOCK_EDGES:
                    yield from done()
                    held, parts = 0, []
        if parts:
            yield from done()

    def meet(table: pa.Table) -> pa.Table:
        kinds, bodies = table.column("kind").to_pylist(), table.column("body").to_pylist()
        out = [(int.from_bytes(b[:8], "big"), 1, b[8:]) for kind, b in zip(kinds, bodies) if kind == 1]
        parts = [unpacked(b, 3) for kind, b in zip(kinds, bodies) if kind == 0]
        if len(parts) > 1:
            h = np.concatenate([np.cumsum(p[0]) for p in parts])
            doc, at = (np.concatenate([p[i] for p in parts]) for i in (1, 2))
            order = np.argsort(h, kind="stable")
            h = h[order]
            same = h[1:] == h[:-1]
            many = np.concatenate([[False], same]) | np.concatenate([same, [False]])
            order, h = order[many], h[many]
            doc, at = doc[order], at[order]
            by = np.lexsort((at, doc, h))
            h, doc, at = h[by], doc[by], at[by]
            if len(h):
                new = np.concatenate([[True], h[1:] != h[:-1]])
                owner = np.maximum.accumulate(np.where(new, np.arange(len(h)), 0))
                out += found_cells(doc, at, doc[owner], at[owner], doc > doc[owner], buckets)
        number, _, body = zip(*out) if out else ((), (), ())
        return pa.table({"home": pa.array(number, pa.int64()), "body": pa.array(body, pa.binary())})

    read_cells = docs.mapInArrow(read, "bucket long, kind int, body binary")
    return read_cells.groupBy("bucket").applyInArrow(meet, "home long, body binary")


def compacted(found: DataFrame) -> DataFrame:
    """(doc, begin, length, source, source_begin): repeated edges joined to the longest paths without a branch.

    Edge follows edge where both the document's and the source's place go on by one. A path ends where its source branches
    off. ``length`` counts edges.
    """

    def join(table: pa.Table) -> pa.Table:
        doc, at, source, source_at = (np.concatenate(x) for x in zip(*[unpacked(b, 4) for b in table.column("body").to_pylist()]))
        by = np.lexsort((source_at, source, at, doc))
        doc, at, source, source_at = doc[by], at[by], source[by], source_at[by]
        # One edge may have two sources, one in its block and one beyond: the smaller document is kept.
        one = np.concatenate([[True], (doc[1:] != doc[:-1]) | (at[1:] != at[:-1])])
        doc, at, source, source_at = doc[one], at[one], source[one], source_at[one]
        on = (doc[1:] == doc[:-1]) & (at[1:] == at[:-1] + 1) & (source[1:] == source[:-1]) & (source_at[1:] == source_at[:-1] + 1)
        first = np.flatnonzero(np.concatenate([[True], ~on]))
        length = np.diff(np.concatenate([first, [len(doc)]]))
        return pa.table({"doc": doc[first], "begin": at[first], "length": length, "source": source[first], "source_begin": source_at[first]})

    return found.groupBy("home").applyInArrow(join, "doc long, begin long, length long, source long, source_begin long")


def digest(words: list[bytes]) -> bytes:
    return hashlib.blake2b(b" ".join(words), digest_size=16).digest()


def source_digests(docs: DataFrame, paths: DataFrame, k: int) -> DataFrame:
    """(source, source_begin, length, digest): the words at every path's source coordinates."""
    spans = paths.select("source", "source_begin", "length").distinct()
    rows = spans.join(docs.select(F.col("doc").alias("source"), "text"), "source").select("source", "source_begin", "length", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[bytes | None, list[bytes]] = (None, [])
        for batch in sliced(batches):
            out = []
            for a, n, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), text_bytes(batch.column(3))):
                if last[0] != text:
                    last = (text, text.split())
                out.append(digest(last[1][a : a + n + k - 1]))
            yield batch_of(source=batch.column(0), source_begin=batch.column(1), length=batch.column(2), digest=pa.array(out, pa.binary()))

    return rows.mapInArrow(run, "source long, source_begin long, length long, digest binary")


def removed_words(text: bytes | None, paths: list[dict] | None, hashes: WordHash, k: int) -> tuple[list[bytes], np.ndarray]:
    """A text's words, and which of them verified paths cover. Every place that has a removed edge is covered."""
    words = text.split() if text else []
    gone = np.zeros(len(words) + 1, np.int64)
    good = [p for p in paths or () if p["begin"] + p["length"] + k - 1 <= len(words) and digest(words[p["begin"] : p["begin"] + p["length"] + k - 1]) == p["digest"]]
    if good:
        h = windows(hashes.of(words), k)
        hit = np.zeros(len(h), bool)
        for p in good:
            hit[p["begin"] : p["begin"] + p["length"]] = True
        hit = np.isin(h, np.unique(h[hit]))
        begin = np.flatnonzero(hit)
        np.add.at(gone, begin, 1)
        np.add.at(gone, begin + k, -1)
    return words, np.cumsum(gone[:-1]) > 0


def deduplicated(docs: DataFrame, k: int = 13, bucket_edges: int = BUCKET_EDGES, id_col: str = "doc_id", text_col: str = "text", broadcast_ids: int = BROADCAST_IDS) -> DataFrame:
    """(doc_id, n_words, n_removed, kept, spans) of every row of ``docs``: texts without words that a smaller document has in a run of ``k``.

    1. Every k-mer of words is an edge between its first and its last k - 1 words, known by a hash. A task sorts its edges
       in blocks; of equal edges in a block only the first occurrence travels, packed with others of its hash range. Groups
       of one range, sized by the corpus, find the edges of several blocks. So an edge in a third of all documents is no
       more than one entry per block.
    2. Repeated edges go home to their document with the coordinates of the smallest document found to have them, and
       compact to paths: stretches that their source runs along without a branch.
    3. Paths meet the texts of their sources in a join, which gives a digest of the words at the source coordinates, and
       then their own documents' texts: only a path whose words have that digest removes anything. A false match of hashes
       therefore leaves words in place and never removes any.

    Only texts that have or give a path move. ``kept`` is the remaining words joined by one space, ``spans`` the removed
    stretches of words [begin, end). Windows are judged on the input.

    Null, empty and short texts lose nothing. Equal ids are one document to one another: neither row removes from the
    other, and each row is judged by its own text. Rows without id give and lose nothing. Other columns are not read. An
    empty table gives an empty table. Ids are whole numbers.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    named = rows.where(F.col("doc").isNotNull())
    size = named.agg(F.sum(F.length("text"))).first()[0] or 0
    buckets = max(1, round(size / 6 / bucket_edges))
    paths = written(compacted(repeated_edges(named, k, buckets)))
    sources, own = paths.select(F.col("source").alias("doc")).distinct(), paths.select("doc").distinct()
    few = paths.select(F.explode(F.array("doc", "source")).alias("doc")).distinct().count() <= broadcast_ids
    some = (lambda ids: F.broadcast(ids)) if few else (lambda ids: ids)
    digests = source_digests(named.join(some(sources), "doc", "left_semi"), paths, k)
    one = F.struct("begin", "length", "digest")
    lists = paths.join(digests, ["source", "source_begin", "length"]).groupBy("doc").agg(F.collect_list(one).alias("paths"))
    kind = lists.schema["paths"].dataType
    if few:
        touched = named.join(some(own), "doc", "left_semi").join(lists, "doc").select("doc", "text", "paths")
        rest = rows.join(some(own), "doc", "left_anti").select("doc", "text", F.lit(None).cast(kind).alias("paths"))
        both = touched.unionByName(rest)
    else:
        both = rows.join(lists, "doc", "left").select("doc", "text", "paths")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches):
            n, lost, kept, spans = [], [], [], []
            for text, mine in zip(text_bytes(batch.column(1)), batch.column(2).to_pylist()):
                words, gone = removed_words(text, mine, hashes, k)
                n.append(len(words))
                lost.append(int(gone.sum()))
                kept.append(b" ".join(words if not lost[-1] else [words[i] for i in np.flatnonzero(~gone)]))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]]))) if lost[-1] else np.empty(0, np.int64)
                spans.append([{"begin": a, "end": b} for a, b in zip(edge[::2].tolist(), edge[1::2].tolist())])
            yield batch_of(
                doc_id=batch.column(0), n_words=pa.array(n, pa.int64()), n_removed=pa.array(lost, pa.int64()),
                kept=pa.array(kept, pa.binary()).cast(pa.string()), spans=pa.array(spans, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            )

    return both.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept string, spans array<struct<begin:int,end:int>>")
