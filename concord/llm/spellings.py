"""Spelling variants: bit-sliced position indexes over the vocabulary, recurrences over zero- and one-error sets."""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import batch_of, sliced, tidy_shuffles, written
from concord.llm.components import roots

#: Words of an index slab, and how many words of one group a cell holds at most before the group is split into a grid.
SLAB, CELL = 512, 2_048
#: Distinct words that a task counts before it hands them on.
HELD_WORDS = 200_000
#: Lower-cases A-Z of Latin-1 bytes, in which every code point up to U+00FF is one byte and all others are "?".
LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def noted_words(doc_id: str, text: str | None, shortest: int, typo: int) -> Counter:
    """The words of one text with counts: runs of letters, of which one in ``typo`` per document lacks a code point.

    A run's hash is the crc32 of ``<doc_id>:<run>``; where ``typo`` divides it, the code point at hash % length goes.
    """
    out: Counter = Counter()
    if not text:
        return out
    runs = re.findall(rb"[a-z\xc0-\xff]{%d,}" % shortest, text.encode("latin-1", "replace").translate(LOWER))
    begin = zlib.crc32(f"{doc_id}:".encode())
    for run, n in Counter(runs).items():
        h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begin)
        if h % typo == 0:
            at = h % len(run)
            run = run[:at] + run[at + 1 :]
            if len(run) < shortest:
                continue
        out[run] += n
    return out


def vocabulary(docs: DataFrame, shortest: int = 6, least: int = 5, typo: int = 199, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n) of all words of at least ``shortest`` code points and ``least`` occurrences; counts are summed before they move."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def rows() -> pa.RecordBatch:
            return batch_of(word=pa.array([w.decode("latin-1") for w in held], pa.string()), n=pa.array(list(held.values()), pa.int64()))

        for batch in sliced(batches):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.update(noted_words(doc_id, text, shortest, typo))
                if len(held) >= HELD_WORDS:
                    yield rows()
                    held.clear()
        yield rows()

    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.col(text_col))
    return rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)


class PositionIndex:
    """For every position and letter, the set of words with that letter there, as bits over the words; and sets by length."""

    def __init__(self, words: list[str]) -> None:
        self.n, self.lengths = len(words), np.array([len(w) for w in words])
        self.letters = {c: i for i, c in enumerate(sorted(set("".join(words))), 1)}
        most = int(self.lengths.max(initial=0)) + 1
        wide = -(-self.n // 64) * 64
        codes = np.zeros((wide, most), np.int32)  # 0: beyond the word's end
        for row, word in zip(codes, words):
            row[: len(word)] = [self.letters[c] for c in word]
        every = np.arange(1, len(self.letters) + 1, dtype=np.int32)[:, None]
        sets = np.zeros((most, len(self.letters) + 1, wide // 8), np.uint8)  # row 0: letters of no word
        for at, here in zip(sets, codes.T):
            at[1:] = np.packbits(here == every, axis=1, bitorder="little")
        self.sets = sets.view(np.uint64)
        of_length = np.concatenate([self.lengths, np.full(wide - self.n, -1)])[None, :] == np.arange(most + 1)[:, None]
        self.by_length = np.packbits(of_length, axis=1, bitorder="little").view(np.uint64)

    def near(self, queries: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(query, word) of words that differ from a query by one replaced or one more code point. Queries share one length.

        All queries go on by one letter at a time, 64 words at once. ``same`` holds the words that begin as the query does,
        ``replaced`` those with one other letter so far, ``longer`` those with one letter more, whose positions are shifted
        by one. A word that lacks a letter of the query is found when it is the query itself.
        """
        size = len(queries[0])
        if size >= len(self.by_length):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        codes = np.array([[self.letters.get(c, 0) for c in q] for q in queries])
        none = np.zeros((len(queries), self.sets.shape[2]), np.uint64)
        same, replaced, longer = ~none, none, none
        for k in range(size):
            here = self.sets[k][codes[:, k]] if k < len(self.sets) else none
            shifted = self.sets[k + 1][codes[:, k]] if k + 1 < len(self.sets) else none
            longer = (longer | same) & shifted
            replaced = (replaced & here) | (same & ~here)
            same = same & here
        longer = longer | same
        found = replaced & self.by_length[size]
        if size + 1 < len(self.by_length):
            found = found | longer & self.by_length[size + 1]
        return np.nonzero(np.unpackbits(found.view(np.uint8), axis=1, bitorder="little")[:, : self.n])


def cells(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(size, part, key, row, col, side, word, n): groups in which all near words meet, large ones split into a grid of cells.

    An edit of a word of ``size`` code points, or of one with one more, leaves either its first size // 2 code points as they
    are or the rest of ``size`` that ends it. So words meet by (size, first half) and by (size, last half), for their own
    size and the one below. A group of more than ``cell`` words is dealt into blocks by hash; block i meets block j in the
    cell (i, j), i <= j, each word on the side of its block.
    """
    own = words.withColumn("size", F.explode(F.array(F.length("word"), F.length("word") - 1)))
    half = (F.col("size") / 2).cast("int")
    first, last = F.substring("word", F.lit(1), half), F.expr("right(word, size - cast(size / 2 AS int))")
    keyed = own.select("word", "n", "size", F.posexplode(F.array(first, last)).alias("part", "key"))
    large = keyed.groupBy("size", "part", "key").agg(F.count("*").alias("members")).where(F.col("members") > cell)
    blocks = F.ceil(F.col("members") / cell).cast("int")
    dealt = keyed.join(large, ["size", "part", "key"], "left").withColumn("blocks", F.coalesce(blocks, F.lit(1)))
    dealt = dealt.withColumn("block", F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int"))
    met = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    row, col = F.least("block", "other"), F.greatest("block", "other")
    return met.select("size", "part", "key", row.alias("row"), col.alias("col"), (F.col("block") > F.col("other")).cast("int").alias("side"), "word", "n")


def slab_pairs(size: int, words: list[str], group: np.ndarray, side: np.ndarray, split: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(query, word): near words of one slab, the query of ``size`` code points. Words meet within their group, and where the
    group is ``split`` only those of its other side."""
    queries = np.array([i for i, w in enumerate(words) if len(w) == size], np.int64)
    index, found = PositionIndex(words), []
    for a in range(0, len(queries), SLAB):
        block = queries[a : a + SLAB]
        query, word = index.near([words[i] for i in block])
        found.append((block[query], word))
    query, word = (np.concatenate(x) for x in zip(*found)) if found else (queries, queries)
    meet = (group[query] == group[word]) & (~split[query] | (side[query] != side[word]))
    return query[meet], word[meet]


def near_pairs(words: DataFrame, cell: int = CELL) -> DataFrame:
    """(word, near, n): every ordered pair of near words of ``words`` (word, n) once, with the occurrences of the second.

    Cells are dealt out by their key and sorted in their task; a task packs whole cells of one size and half into slabs of
    about SLAB words, so many small groups share an index. A pair that meets by both halves is kept by the first.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slab: list[tuple] = []  # (cell, side, word, n)

        def done(rows: list[tuple]) -> pa.RecordBatch:
            names, n = [r[2] for r in rows], np.array([r[3] for r in rows], np.int64)
            group = np.cumsum([i > 0 and r[0] != rows[i - 1][0] for i, r in enumerate(rows)])
            split = np.array([r[0][3] != r[0][4] for r in rows], bool)
            size, part = rows[0][0][:2]
            query, word = slab_pairs(size, names, group, np.array([r[1] for r in rows]), split)
            if part:  # found by their last halves: pairs with equal first halves are found there
                other = np.array([names[q][: size // 2] != names[w][: size // 2] for q, w in zip(query, word)], bool)
                query, word = query[other], word[other]
            longer = np.array([len(names[w]) > size for w in word], bool)  # equal sizes find each other both ways
            one = np.concatenate([query, word[longer]])
            two = np.concatenate([word, query[longer]])
            return batch_of(word=pa.array([names[i] for i in one], pa.string()), near=pa.array([names[i] for i in two], pa.string()), n=n[two])

        for batch in batches:
            columns = batch.to_pydict()
            for size, part, key, row, col, side, word, n in zip(*(columns[c] for c in ("size", "part", "key", "row", "col", "side", "word", "n"))):
                cell_key = (size, part, key, row, col)
                if slab and slab[-1][0] != cell_key and (len(slab) >= SLAB or slab[0][0][:2] != cell_key[:2]):
                    yield done(slab)
                    slab = []
                slab.append((cell_key, side, word, n))
        if slab:
            yield done(slab)

    keys = ["size", "part", "key", "row", "col"]
    met = cells(words, cell).repartition(*keys).sortWithinPartitions(*keys)
    return met.mapInArrow(run, "word string, near string, n long")


def spellings(
    docs: DataFrame, shortest: int = 6, least: int = 5, typo: int = 199, times: int = 5, id_col: str = "doc_id", text_col: str = "text", cell: int = CELL,
) -> DataFrame:
    """(word, n, n_near, form, form_n, root) of every word of at least ``shortest`` code points and ``least`` occurrences.

    Words are runs of ``A-Za-z`` and U+00C0 to U+00FF in lower case (A-Z only), some of which lose a code point by a hash of
    their document's id, as ``noted_words`` says. n_near counts the words at one inserted, deleted or replaced code point. A
    word's form is the commonest of them, the first in code-point order of equals, if it occurs ``times`` as often; root
    follows forms to the last.

    Words that may be near meet in groups that share half of their letters; a group's words are indexed by bitsets per
    position and letter, and all words of the slab are tested 64 at a time. Groups of over ``cell`` words are split into a
    grid of cells, so that no task holds a group; the work within one is quadratic in its words, at 64 words a step, and the
    pairs that leave are near words only. The vocabulary is written out once, forms are followed by pointer jumping (a form
    occurs ``times`` as often, so chains are short). Nothing but Spark's own small broadcasts moves to all tasks.

    Null texts have no words; a null id counts as empty text before the colon. Repeated rows count as often as they stand
    there. Other columns are not read. An empty table, or one without such words, gives an empty table.
    """
    tidy_shuffles(docs.sparkSession)
    words = written(vocabulary(docs, shortest, least, typo, id_col, text_col))
    pairs = near_pairs(words, cell)
    best = pairs.groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("n")).alias("less"), "near")).alias("most"))
    joined = words.join(best, "word", "left")
    is_form = -F.col("most.less") >= times * F.col("n")
    noted = written(joined.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("most.near")).alias("form"), F.when(is_form, -F.col("most.less")).alias("form_n"),
    ))
    forms = noted.where("form IS NOT NULL").select(F.col("word").alias("node"), F.col("form").alias("parent"))
    last = roots(forms, forms.count())
    return noted.join(last.withColumnRenamed("node", "word"), "word", "left").withColumn("root", F.coalesce("root", "word"))
