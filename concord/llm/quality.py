"""A quality classifier: a factorisation machine over hashed words, structure statistics and metadata."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from concord.llm.common import WordHash, batch_of, sliced, text_bytes

WORD_BITS = 15
#: Statistics of a text's structure; each is one feature with its value. The last is metadata: the stated length.
STATS = (
    "bytes", "words", "upper", "lower", "digits", "spaces", "newlines", "bars", "marks", "other", "word_length",
    "distinct", "commonest", "marked_words", "repeated_lines", "line_length", "empty", "stated_length",
)
#: Words handled at once, whatever the batch: bounds a task's memory.
SLICE_WORDS = 250_000


def structure(text: bytes, words: list[bytes], counts: np.ndarray, stated: float | None) -> list[float]:
    """The statistics of one text, each scaled to about [0, 1]. ``counts``: how often each distinct word occurs."""
    n, m = len(text), len(words)
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256) if n else np.zeros(256, np.int64)
    part = lambda a, b: float(seen[a:b].sum()) / max(n, 1)
    lines = text.split(b"\n")
    full = [x for x in lines if x.strip()]
    marks = part(33, 48) + part(58, 65) + part(91, 97) + part(123, 124) + part(125, 127)
    marked = sum(1 for w in words if w[-1] in b"!#$%&*+/<=>@\\^_|~") / max(m, 1)
    return [
        np.log1p(n) / 12, np.log1p(m) / 10, part(65, 91), part(97, 123), part(48, 58), part(32, 33), part(10, 11) * 10, part(124, 125),
        marks, part(128, 256), min(n / max(m, 1), 40) / 20, len(counts) / max(m, 1), float(counts.max(initial=0)) / max(m, 1), marked,
        1 - len(set(full)) / max(len(full), 1), min(n / max(len(lines), 1), 2000) / 1000, float(m == 0), np.log1p(max(stated or 0, 0)) / 12,
    ]


@dataclass
class Rows:
    """Sparse rows: row i has features ``index[start[i]:start[i + 1]]`` with values ``value``, and dense ``stats``."""

    start: np.ndarray
    index: np.ndarray
    value: np.ndarray
    stats: np.ndarray


def features(texts: list[bytes | None], stated: list[float | None], hashes: WordHash) -> Iterator[tuple[int, Rows]]:
    """Rows of ``texts`` in slices of about SLICE_WORDS words, each with the number of its first text.

    A word's value is the logarithm of its count, all scaled to length one in a text.
    """
    first, held, keys, lists = 0, 0, [], []

    def done() -> Rows:
        key = np.concatenate(keys) if keys else np.empty(0, np.int64)
        unique, count = np.unique(key, return_counts=True)
        row = unique >> WORD_BITS
        value = np.log1p(count).astype(np.float32)
        start = np.searchsorted(row, np.arange(len(lists) + 1))
        norm = np.sqrt(np.bincount(row, value * value, len(lists)))
        value /= norm[row].astype(np.float32)
        stats = [structure(t, w, count[a:b], s) for (t, w, s), a, b in zip(lists, start, start[1:])]
        return Rows(start, (unique & ((1 << WORD_BITS) - 1)).astype(np.int32), value, np.array(stats, np.float32).reshape(-1, len(STATS)))

    for i, (text, length) in enumerate(zip(texts, stated)):
        words = (text or b"").split()
        keys.append((hashes.of(words) & np.uint64((1 << WORD_BITS) - 1)).astype(np.int64) | len(lists) << WORD_BITS)
        lists.append((text or b"", words, length))
        held += len(words)
        if held >= SLICE_WORDS:
            yield first, done()
            first, held, keys, lists = i + 1, 0, [], []
    if lists:
        yield first, done()


def sums(values: np.ndarray, start: np.ndarray) -> np.ndarray:
    """Sum of ``values`` over each row's features, without loss for rows that have none."""
    out = np.zeros((len(start) - 1, *values.shape[1:]), values.dtype)
    full = np.flatnonzero(start[1:] > start[:-1])
    if len(full):
        out[full] = np.add.reduceat(values, start[full])
    return out


@dataclass
class Machine:
    """Weights of a factorisation machine over ``2**WORD_BITS`` hashed words and the statistics.

    A score takes time linear in the features: the sum over pairs of <v_i, v_j> x_i x_j is half of the square of the sum
    of v_i x_i less the sum of their squares.
    """

    rank: int = 8
    seed: int = 7
    bias: float = 0.0
    linear: np.ndarray = field(default=None)  # type: ignore[assignment]
    pairs: np.ndarray = field(default=None)  # type: ignore[assignment]
    middle: np.ndarray = field(default=None)  # type: ignore[assignment]
    spread: np.ndarray = field(default=None)  # type: ignore[assignment]

    def __post_init__(self) -> None:
        n = (1 << WORD_BITS) + len(STATS)
        draw = np.random.default_rng(self.seed)
        self.linear = np.zeros(n, np.float32)
        self.pairs = (draw.standard_normal((n, self.rank)) * 0.05).astype(np.float32)
        self.middle, self.spread = np.zeros(len(STATS), np.float32), np.ones(len(STATS), np.float32)

    def scaled(self, stats: np.ndarray) -> np.ndarray:
        return np.clip((stats - self.middle) / self.spread, -4, 4) / 2

    def raw(self, rows: Rows) -> tuple[np.ndarray, np.ndarray]:
        """The score before the logistic curve, and each row's sum of v_i x_i."""
        words, n = 1 << WORD_BITS, len(rows.stats)
        stats = self.scaled(rows.stats)
        v, x = self.pairs[rows.index], rows.value[:, None]
        vx = v * x
        total = sums(vx, rows.start) + stats @ self.pairs[words:]
        squares = sums(vx * vx, rows.start).sum(1) + (stats * stats) @ (self.pairs[words:] ** 2).sum(1)
        line = sums(self.linear[rows.index] * rows.value, rows.start) + stats @ self.linear[words:]
        return (self.bias + line + 0.5 * ((total * total).sum(1) - squares)).astype(np.float64).reshape(n), total

    def score(self, rows: Rows) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(rows)[0], -30, 30)))

    def fit(self, rows: Rows, labels: np.ndarray, epochs: int = 12, batch: int = 256, rate: float = 0.05, decay: float = 1e-5) -> Machine:
        """Logistic loss by AdaGrad over shuffled batches."""
        if not len(labels):
            return self
        words, draw = 1 << WORD_BITS, np.random.default_rng(self.seed + 1)
        self.middle, self.spread = rows.stats.mean(0), np.maximum(rows.stats.std(0), 1e-3)
        share = np.clip(labels.mean(), 0.02, 0.98)
        self.bias = float(np.log(share / (1 - share)))
        g_line, g_pairs, g_bias = np.full(len(self.linear), 1e-3, np.float32), np.full(self.pairs.shape, 1e-3, np.float32), 1e-3
        for _ in range(epochs):
            order = draw.permutation(len(labels))
            for at in range(0, len(order), batch):
                pick = order[at : at + batch]
                spans = [np.arange(rows.start[i], rows.start[i + 1]) for i in pick]
                where = np.concatenate(spans)
                part = Rows(np.concatenate([[0], np.cumsum([len(s) for s in spans])]), rows.index[where], rows.value[where], rows.stats[pick])
                raw, total = self.raw(part)
                off = ((1 / (1 + np.exp(-np.clip(raw, -30, 30))) - labels[pick]) / len(pick)).astype(np.float32)
                stats = self.scaled(part.stats)
                row = np.repeat(np.arange(len(pick)), np.diff(part.start))
                used, slot = np.unique(part.index, return_inverse=True)
                x = part.value
                d_line = np.bincount(slot, off[row] * x, len(used))
                vx = self.pairs[part.index] * x[:, None]
                d = (off[row] * x)[:, None] * (total[row] - vx)
                d_pairs = np.stack([np.bincount(slot, d[:, k], len(used)) for k in range(self.rank)], 1)
                at_words = [(used, d_line, d_pairs)]
                sv = self.pairs[words:]
                d_sline = off @ stats
                d_spairs = np.einsum("i,ij,ik->jk", off, stats, total) - np.einsum("i,ij->j", off, stats * stats)[:, None] * sv
                at_words.append((np.arange(words, words + len(STATS)), d_sline, d_spairs))
                for ids, dl, dp in at_words:
                    dl, dp = dl + decay * self.linear[ids], dp + decay * self.pairs[ids]
                    g_line[ids] += dl * dl
                    g_pairs[ids] += dp * dp
                    self.linear[ids] -= (rate * dl / np.sqrt(g_line[ids])).astype(np.float32)
                    self.pairs[ids] -= (rate * dp / np.sqrt(g_pairs[ids])).astype(np.float32)
                d_bias = float(off.sum())
                g_bias += d_bias * d_bias
                self.bias -= rate * d_bias / g_bias**0.5
        return self


def held_out(id_col: Column) -> Column:
    """Whether a document's label is kept for testing: crc32 of the id as text leaves no remainder by 5."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fit_machine(
    docs: DataFrame, labels: DataFrame, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text", length_col: str = "n_chars",
    label_col: str = "quality", rank: int = 8,
) -> Machine:
    """A machine fitted on ``most`` labelled rows at most, those of lowest hash among the rows not held out.

    The bound is a parameter; nothing but the fit is bounded. Of the rows of an id the one of least text hash is taken. Labels other than 0 and 1 and null ids are left out, ids with
    conflicting labels count as 0. Without labels the machine scores every text one half.
    """
    usable = labels.where(F.col(id_col).isNotNull() & F.col(label_col).isin(0, 1) & ~held_out(F.col(id_col)))
    usable = usable.groupBy(F.col(id_col).alias("id")).agg(F.min(label_col).alias("label"))
    sample = usable.orderBy(F.xxhash64("id"), "id").limit(most)  # top rows of each partition meet, not all rows
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(length_col).cast("double").alias("stated"))
    one = F.min_by(F.struct("text", "stated"), F.struct(F.xxhash64("text"), "stated", "text")).alias("row")  # within each task first
    joined = rows.join(F.broadcast(sample), "id").groupBy("id", "label").agg(one).select("id", "label", "row.text", "row.stated")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHash()
        for batch in sliced(batches):
            for first, part in features(text_bytes(batch.column(2)), batch.column(3).to_pylist(), hashes):
                n = len(part.stats)
                cut = lambda a: [a[x:y].tobytes() for x, y in zip(part.start, part.start[1:])]
                yield batch_of(
                    id=batch.column(0).slice(first, n), label=batch.column(1).slice(first, n).cast(pa.int32()), place=cut(part.index),
                    value=cut(part.value), stats=[s.tobytes() for s in part.stats],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    got = joined.mapInArrow(run, f"id {kind}, label int, place binary, value binary, stats binary").collect()
    got = sorted(got, key=lambda r: str(r.id))
    sizes = [len(r.place) // 4 for r in got]
    rows_in = Rows(
        np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64), np.frombuffer(b"".join(r.place for r in got), np.int32),
        np.frombuffer(b"".join(r.value for r in got), np.float32), np.frombuffer(b"".join(r.stats for r in got), np.float32).reshape(-1, len(STATS)),
    )
    return Machine(rank).fit(rows_in, np.array([r.label for r in got], np.float32))


def quality_scores(
    docs: DataFrame, labels: DataFrame, threshold: float = 0.3, most: int = 8_000, id_col: str = "doc_id", text_col: str = "text",
    length_col: str = "n_chars", label_col: str = "quality", keep: bool = False,
) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs``; with ``keep``, all columns of ``docs`` and these.

    The inputs of a score are the whole text and its stated length; neither the id, nor the language, the source or any
    label. The machine is fitted first (see ``fit_machine``, the only bounded sample); scoring is one pass over the scan
    without a shuffle, in slices of a fixed number of words. The machine travels in the function (1.2 MB).

    Null and empty texts are scored from their statistics. Repeated rows and ids get a row each; a null id is not held
    out. With ``keep``, columns named as a result are replaced by it. An empty table gives an empty table.
    """
    docs = docs if length_col in docs.columns else docs.withColumn(length_col, F.lit(None).cast("long"))
    machine = docs.sparkSession.sparkContext.broadcast(fit_machine(docs, labels, most, id_col, text_col, length_col, label_col))
    extra = [c for c in docs.columns if c not in ("held_out", "score", "predicted")] if keep else []
    cols = [F.col(id_col).alias("__id"), F.col(text_col).alias("__text"), F.col(length_col).cast("double").alias("__stated"), held_out(F.col(id_col)).alias("__held")]
    rows = docs.select(*extra, *cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, fitted = WordHash(), machine.value
        for batch in sliced(batches):
            texts, stated = text_bytes(batch.column("__text")), batch.column("__stated").to_pylist()
            scores = [fitted.score(part) for _, part in features(texts, stated, hashes)]
            score = np.concatenate(scores) if scores else np.empty(0)
            columns = {c: batch.column(c) for c in extra} if keep else {"doc_id": batch.column("__id")}
            yield batch_of(**columns, held_out=batch.column("__held"), score=score, predicted=pa.array((score >= threshold).astype(np.int32)))

    kind = docs.schema[id_col].dataType.simpleString()
    named = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in extra) if keep else f"doc_id {kind}"
    return rows.mapInArrow(run, f"{named}, held_out boolean, score double, predicted int")
