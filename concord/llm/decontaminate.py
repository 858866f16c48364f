"""Benchmark decontamination: an FM-index for each shard of training words, searched backwards for the benchmark's windows."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import batch_of, durable, sliced, text_bytes, written

#: What a word is made of, in lower case: digits, letters a to z, and all bytes of other alphabets.
KEPT = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
WORD_BYTES = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
#: Words and documents of a shard; a document is never split, so the longest may exceed it.
SHARD_WORDS, SHARD_ROWS = 2_000_000, 4_000
#: Windows searched in one pass. More are searched in further passes, each with its own broadcast of at most so many.
BLOCK_WINDOWS = 200_000
SAMPLE = 16


def split_words(text: bytes | None) -> list[bytes]:
    return text.translate(KEPT).split() if text else []


class WaveletMatrix:
    """Ranks and symbols of a sequence of small integers, in one step per bit."""

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        self.bits, self.ones, self.zeros = bits, [], []
        for bit in range(bits - 1, -1, -1):
            up = symbols >> bit & 1
            ones = np.zeros(len(symbols) + 1, np.int32)
            np.cumsum(up, out=ones[1:])
            self.ones.append(ones)
            self.zeros.append(len(symbols) - int(ones[-1]))
            symbols = np.concatenate([symbols[up == 0], symbols[up == 1]])

    def mapped(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Where prefix ``at`` of the sequence ends among equal symbols in the last level."""
        for level in range(self.bits):
            ones = self.ones[level][at]
            at = np.where(symbols >> (self.bits - 1 - level) & 1, self.zeros[level] + ones, at - ones)
        return at

    def rank(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        """How often each symbol occurs in the sequence before ``at``."""
        return self.mapped(symbols, at) - self.mapped(symbols, np.zeros_like(at))

    def access(self, at: np.ndarray) -> np.ndarray:
        out = np.zeros(len(at), np.int64)
        for level in range(self.bits):
            ones = self.ones[level]
            before = ones[at]
            up = ones[at + 1] - before
            out = out << 1 | up
            at = np.where(up, self.zeros[level] + before, at - before)
        return out


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Suffixes in order by prefix doubling; each 0 ends a run and counts as another symbol, so no suffix is read past its run.

    After each round only suffixes that still share their prefix are sorted again.
    """
    n = len(symbols)
    ends = np.flatnonzero(symbols == 0)
    rank = symbols.astype(np.int64) + len(ends)
    rank[ends] = np.arange(len(ends))
    order = np.argsort(rank, kind="stable")
    sorted_rank = rank[order]
    fresh = np.concatenate([[True], sorted_rank[1:] != sorted_rank[:-1]])
    starts = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
    rank[order] = starts
    width = 1
    while True:
        # A group is a maximal stretch of one rank; those of one suffix are done.
        single = fresh & np.concatenate([fresh[1:], [True]])
        open_at = np.flatnonzero(~single)
        if not len(open_at):
            return order
        suffix = order[open_at]
        group = rank[suffix]
        beyond = np.minimum(suffix + width, n - 1)
        key = group * (n + 1) + rank[beyond]
        by = np.argsort(key, kind="stable")
        order[open_at] = suffix[by]
        key = key[by]
        new = np.concatenate([[True], key[1:] != key[:-1]])
        fresh[open_at] = new
        starts = np.maximum.accumulate(np.where(new, open_at, 0))
        rank[suffix[by]] = starts
        width *= 2


class FMIndex:
    """An index of a sequence of symbols 0 .. ``2**bits - 1``; 0 ends a run and is in no pattern.

    Kept: the wavelet matrix of the symbols before each suffix, the number of smaller symbols, and the positions of
    sampled suffixes: every SAMPLE-th and the first of each run, so that a walk back never leaves its run.
    """

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        order = suffix_order(symbols)
        before = symbols[order - 1]  # position 0 is a run's end, as is the last
        self.tree = WaveletMatrix(before, bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        sampled = (order % SAMPLE == 0) | (before == 0)
        self.sampled = np.concatenate([[0], np.cumsum(sampled, dtype=np.int32)])
        self.positions = order[sampled]

    def step(self, symbols: np.ndarray, at: np.ndarray) -> np.ndarray:
        return self.smaller[symbols] + self.tree.rank(symbols, at)

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows [low, high) of each pattern, by steps from its last symbol to its first."""
        n = self.smaller[-1]
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), n, np.int64)
        live = np.flatnonzero(lengths > 0)
        for back in range(1, patterns.shape[1] + 1):
            live = live[(lengths[live] >= back) & (low[live] < high[live])]
            if not len(live):
                break
            symbols = patterns[live, lengths[live] - back]
            low[live], high[live] = self.step(symbols, low[live]), self.step(symbols, high[live])
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Positions of the suffixes in ``rows``: walk back to a sampled one and add the steps."""
        out, walk, steps = np.empty(len(rows), np.int64), np.arange(len(rows)), 0
        rows = rows.copy()
        while len(walk):
            is_sample = self.sampled[rows + 1] > self.sampled[rows]
            out[walk[is_sample]] = self.positions[self.sampled[rows[is_sample]]] + steps
            walk, rows = walk[~is_sample], rows[~is_sample]
            rows = self.step(self.tree.access(rows), rows)
            steps += 1
        return out


@dataclass
class Windows:
    """A block of windows: words numbered from 1, patterns padded with 0, and the items of each pattern."""

    words: dict[bytes, int]
    patterns: np.ndarray
    lengths: np.ndarray
    first: np.ndarray
    items: list[str]

    @classmethod
    def of(cls, rows: list[tuple[bytes, str]]) -> Windows:
        by: dict[bytes, set[str]] = {}
        for window, item in rows:
            by.setdefault(window, set()).add(item)
        ordered = sorted(by)
        words: dict[bytes, int] = {}
        numbered = [[words.setdefault(w, len(words) + 1) for w in window.split(b" ")] for window in ordered]
        lengths = np.array([len(x) for x in numbered], np.int64)
        patterns = np.zeros((len(numbered), int(lengths.max(initial=1))), np.int64)
        for row, x in zip(patterns, numbered):
            row[: len(x)] = x
        items = [sorted(by[w]) for w in ordered]
        return cls(words, patterns, lengths, np.concatenate([[0], np.cumsum([len(x) for x in items])]).astype(np.int64), [i for x in items for i in x])

    def occurrences(self, symbols: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(position, pattern) of all occurrences in ``symbols``, where 0 is any word of no window."""
        if not len(self.lengths):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        # Only runs of window words as long as the shortest window can hold one; the index is of those runs.
        edge = np.flatnonzero(np.diff(np.concatenate([[0], (symbols > 0).astype(np.int8), [0]])))
        begin, end = edge[::2], edge[1::2]
        long = end - begin >= self.lengths.min()
        begin, end = begin[long], end[long]
        if not len(begin):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        size = end - begin + 1
        start = np.cumsum(size) - size + 1  # after a leading 0
        kept = np.zeros(int(size.sum()) + 1, np.int64)
        shift = np.repeat(begin - start, size - 1)
        at = np.arange(len(shift)) + np.repeat(np.arange(len(begin)), size - 1) + 1
        kept[at] = symbols[at + shift]
        index = FMIndex(kept, max(1, len(self.words).bit_length()))
        low, high = index.search(self.patterns, self.lengths)
        count = np.maximum(high - low, 0)
        pattern = np.repeat(np.arange(len(count)), count)
        rows = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count) + np.repeat(low, count)
        position = index.locate(rows)
        run = np.searchsorted(start, position, "right") - 1
        return position + (begin - start)[run], pattern


def benchmark_windows(benchmark: DataFrame, width: int, id_col: str = "item_id", text_col: str = "text") -> DataFrame:
    """(window, item): every run of ``width`` words of an item, or all its words if it has fewer; items as text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SHARD_ROWS):
            windows, items = [], []
            for item, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
                words = split_words(text)
                for i in range(max(1, len(words) - width + 1) if words else 0):
                    windows.append(b" ".join(words[i : i + width]))
                    items.append(item)
            yield batch_of(window=pa.array(windows, pa.binary()), item=pa.array(items, pa.string()))

    named = benchmark.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("string"), F.col(text_col))
    return named.mapInArrow(run, "window binary, item string").distinct()


def _search(docs: DataFrame, block: object, text_col: str) -> DataFrame:
    """``docs`` with ``__spans`` and ``__items`` lengthened by what a block of windows finds in them."""
    fields = [f.name for f in docs.schema if f.name not in ("__spans", "__items")]
    spans_type, items_type = pa.list_(pa.int32()), pa.list_(pa.string())

    def shard(found: Windows, counts: list[int], symbols: list[np.ndarray]) -> Iterator[tuple[list[int], list[str]]]:
        """Flat merged spans and items of each document of a shard."""
        start = np.concatenate([[0], np.cumsum(np.array(counts, np.int64) + 1)])
        flat = np.zeros(int(start[-1]), np.int64)  # a 0 after each document
        for a, x in zip(start, symbols):
            flat[a : a + len(x)] = x
        position, pattern = found.occurrences(flat)
        order = np.argsort(position, kind="stable")
        position, pattern = position[order], pattern[order]
        edge = np.searchsorted(position, start)
        for i, (a, b) in enumerate(zip(edge, edge[1:])):
            spans: list[int] = []
            for p, length in zip((position[a:b] - start[i]).tolist(), found.lengths[pattern[a:b]].tolist()):
                if spans and p <= spans[-1]:
                    spans[-1] = max(spans[-1], p + length)
                else:
                    spans += [p, p + length]
            items = {x for k in np.unique(pattern[a:b]).tolist() for x in found.items[found.first[k] : found.first[k + 1]]}
            yield spans, sorted(items)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Windows = block.value  # type: ignore[attr-defined]
        get = found.words.get
        for batch in sliced(batches, SHARD_ROWS):
            texts = text_bytes(batch.column(text_col))
            out: list[tuple[list[int], list[str]]] = []
            counts, symbols, held = [], [], 0
            sizes = []
            for text in texts:
                words = split_words(text)
                counts.append(len(words))
                symbols.append(np.array([get(w, 0) for w in words], np.int32))
                held += len(words)
                if held >= SHARD_WORDS:
                    out += shard(found, counts, symbols)
                    sizes += counts
                    counts, symbols, held = [], [], 0
            if counts:
                out += shard(found, counts, symbols)
                sizes += counts
            spans, items = [x[0] for x in out], [x[1] for x in out]
            if "__spans" in batch.schema.names:
                spans = [a + b for a, b in zip(batch.column("__spans").to_pylist(), spans)]
                items = [a + b for a, b in zip(batch.column("__items").to_pylist(), items)]
            columns = {n: batch.column(n) for n in fields if n != "__n_words"}
            yield batch_of(**columns, __n_words=pa.array(sizes, pa.int64()), __spans=pa.array(spans, spans_type), __items=pa.array(items, items_type))

    kept = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in fields and f.name != "__n_words"]
    return docs.mapInArrow(run, ", ".join([*kept, "__n_words long, __spans array<int>, __items array<string>"]))


def searched(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK_WINDOWS, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """``docs`` with ``__n_words``, ``__spans`` (flat pairs of word numbers) and ``__items``, from all blocks of windows."""
    windows = durable(benchmark_windows(benchmark, width, item_col))
    context = docs.sparkSession.sparkContext
    blocks = -(-windows.count() // block) or 1
    for i in range(blocks):
        rows = windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(blocks)) == i).collect()
        docs = _search(docs, context.broadcast(Windows.of([(bytes(r.window), r.item) for r in rows])), text_col)
        if i % 4 == 3 and i + 1 < blocks:
            docs = written(docs)
    return docs


def merged(spans: list[int]) -> list[int]:
    """Flat pairs in order and apart."""
    out: list[int] = []
    for a, b in sorted(zip(spans[::2], spans[1::2])):
        if out and a <= out[-1]:
            out[-1] = max(out[-1], b)
        else:
            out += [a, b]
    return out


def contamination(
    docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK_WINDOWS, id_col: str = "doc_id", text_col: str = "text",
    item_col: str = "item_id",
) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row of ``docs``: the words inside occurrences of benchmark windows.

    A window is ``width`` consecutive words of an item, or all of an item that has fewer. Texts are dealt with in shards
    of about SHARD_WORDS words. A shard is numbered by the windows' words, runs too short for any window are left out, and
    an FM-index of the rest is searched backwards for all windows at once; the suffixes in their rows are located from
    sampled positions, and occurrences merge to spans of words [begin, end). One pass over the scan, no shuffle.

    The windows are the stated queries. They are searched in blocks of ``block`` windows, each broadcast on its own, so
    neither a broadcast nor a worker's memory grows with the benchmark.

    Null and empty texts have no words; null or wordless items have no windows, items without id are left out. Repeated
    documents get a row each, repeated items count once. An empty benchmark hits nothing, an empty table gives an empty
    table. Other columns are not read.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    found = searched(rows, benchmark, width, block, "text", item_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SHARD_ROWS):
            spans = [merged(x) for x in batch.column("__spans").to_pylist()]
            items = [sorted(set(x)) for x in batch.column("__items").to_pylist()]
            pairs = [[{"begin": a, "end": b} for a, b in zip(x[::2], x[1::2])] for x in spans]
            yield batch_of(
                doc_id=batch.column("doc_id"), n_words=batch.column("__n_words"), n_hit=pa.array([sum(x[1::2]) - sum(x[::2]) for x in spans], pa.int64()),
                items=pa.array(items, pa.list_(pa.string())), spans=pa.array(pairs, pa.list_(pa.struct([("begin", pa.int32()), ("end", pa.int32())]))),
            )

    kind = docs.schema[id_col].dataType.simpleString()
    return found.drop("text").mapInArrow(run, f"doc_id {kind}, n_words long, n_hit long, items array<string>, spans array<struct<begin:int,end:int>>")


def digest(found: DataFrame) -> DataFrame:
    """The contract's columns: items as their number and the hash of their ids, sorted as text and comma-joined."""
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def cleaned(docs: DataFrame, benchmark: DataFrame, width: int = 10, block: int = BLOCK_WINDOWS, text_col: str = "text", item_col: str = "item_id") -> DataFrame:
    """All rows and columns of ``docs``, texts without the spans that the benchmark's windows cover.

    A span goes from its first word's begin to its last word's end; what stands around it stays. Texts that hold no window
    are kept byte for byte.
    """
    found = searched(docs, benchmark, width, block, text_col, item_col)
    names = docs.columns

    def cut(text: bytes, spans: list[int]) -> bytes:
        places = [m.span() for m in WORD_BYTES.finditer(text)]
        parts, at = [], 0
        for a, b in zip(spans[::2], spans[1::2]):
            parts.append(text[at : places[a][0]])
            at = places[b - 1][1]
        return b"".join([*parts, text[at:]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, SHARD_ROWS):
            texts, spans = batch.column(text_col).to_pylist(), batch.column("__spans").to_pylist()
            new = [cut(t.encode("utf-8"), merged(x)).decode("utf-8") if x else t for t, x in zip(texts, spans)]
            yield batch_of(**{f: pa.array(new, pa.string()) if f == text_col else batch.column(f) for f in names})

    return found.drop("__n_words", "__items").mapInArrow(run, ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema))
