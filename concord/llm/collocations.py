"""Phrase collocations: an FM-index per shard over word ids, bidirectional interval extension, counts summed across shards."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import WordHash, batch_of, mix, text_bytes, tidy_shuffles, written
from concord.llm.decontaminate import WaveletMatrix

#: Words of a shard; a text is never split, so the longest may exceed it.
SHARD_WORDS = 1_000_000
#: Words of the longest phrase: suffixes are sorted by so many words.
DEPTH = 3
#: Bits of the filters of words and of pairs that may be frequent enough (2 and 16 MB).
WORD_BITS, PAIR_BITS = 24, 27
#: Rows of a batch that leaves a shard.
ROWS = 100_000
#: Lower-cases A-Z, ends pieces at line feeds and parts words at spaces.
PIECES = bytes(10 if c in b".,;:!?\x0a\x0b\x0c\x0d" else 32 if c == 9 else c + 32 if 65 <= c <= 90 else c for c in range(256))
#: Salts of the first ranks of a language.
RANK_SALTS = 64


@dataclass
class Shard:
    """Texts of one language as word ids from 1, a 0 after each piece; ``words`` has the words by id, the first for 0."""

    language: str
    words: pa.Array
    ids: np.ndarray

    @classmethod
    def of(cls, language: str, texts: list[bytes]) -> Shard:
        """``texts``: with PIECES applied, a space between any two words or line feeds."""
        tokens = pc.split_pattern(pa.array(texts, pa.string()), " ").flatten().dictionary_encode()
        named = tokens.dictionary
        full = np.ones(len(named), bool)
        end, nothing = pc.index(named, "\n").as_py(), pc.index(named, "").as_py()
        full[[i for i in (end, nothing) if i >= 0]] = False
        to = np.where(full, np.cumsum(full), -1)
        to[end] = 0
        ids = to[tokens.indices.to_numpy()]
        return cls(language, pa.concat_arrays([pa.array([""], pa.string()), named.filter(pa.array(full))]).cast(pa.binary()), ids[ids >= 0])

    def hashes(self) -> np.ndarray:
        """64-bit hashes of the language's words by id."""
        digest = WordHash().digest
        seed = digest(self.language.encode())
        return np.fromiter((digest(w, seed) for w in self.words.to_pylist()), np.uint64, len(self.words))


def shards(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[Shard]:
    """Shards of the batches' (lang, text): the largest language's is given out whenever all held texts have ``most`` words."""
    texts: dict[str, list[bytes]] = {}
    words: Counter = Counter()
    held = 0
    for batch in batches:
        for language, text in zip(batch.column(0).to_pylist(), text_bytes(batch.column(1))):
            if not text:
                continue
            spaced = text.translate(PIECES).replace(b"\n", b" \n ") + b" \n"
            texts.setdefault(language, []).append(spaced)
            n = spaced.count(b" ")
            words[language] += n
            held += n
            while held >= most:
                largest = max(words, key=words.__getitem__)
                held -= words.pop(largest)
                yield Shard.of(largest, texts.pop(largest))
    for language in sorted(texts):
        yield Shard.of(language, texts[language])


def suffix_order(symbols: np.ndarray, bits: int) -> np.ndarray:
    """Suffixes in order of their first DEPTH symbols; the sequence ends with zeros enough."""
    padded = np.concatenate([symbols, np.zeros(DEPTH, symbols.dtype)]).astype(np.int64)
    n = len(symbols)
    if bits * DEPTH < 64:
        key = np.zeros(n, np.int64)
        for i in range(DEPTH):
            key = key << bits | padded[i : n + i]
        return np.argsort(key)
    return np.lexsort([padded[i : n + i] for i in range(DEPTH - 1, -1, -1)])


class Index:
    """An FM-index over a sequence of word ids, suffixes sorted by DEPTH words: exact for patterns of up to DEPTH words.

    The order of suffixes with equal first words is not needed: an interval of a pattern of less than DEPTH words keeps the
    same suffixes, and the words before them, whatever their order beyond.
    """

    def __init__(self, symbols: np.ndarray, bits: int) -> None:
        order = suffix_order(symbols, bits)
        self.tree = WaveletMatrix(symbols[order - 1], bits)
        self.smaller = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=1 << bits))])
        every = np.arange(1 << bits)
        self.begin = self.tree.mapped(every, np.zeros_like(every))

    def extended(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Every extension to the left of the intervals [low, high): parent, symbol, new interval and the offset that the
        extension has in the other direction's interval: how many occurrences come before a smaller symbol.

        All intervals go down the wavelet matrix together; a level parts each into its zeros and ones, empty parts go.
        Extensions come in order of parent and symbol.
        """
        parent, symbol, tree = np.arange(len(low)), np.zeros(len(low), np.int64), self.tree
        for level in range(tree.bits):
            ones, zeros = tree.ones[level], tree.zeros[level]
            low_ones, high_ones = ones[low].astype(np.int64), ones[high].astype(np.int64)
            lows = np.stack([low - low_ones, zeros + low_ones], 1).ravel()
            highs = np.stack([high - high_ones, zeros + high_ones], 1).ravel()
            full = np.flatnonzero(highs > lows)
            low, high = lows[full], highs[full]
            parent, symbol = parent[full >> 1], symbol[full >> 1] << 1 | (full & 1)
        count = high - low
        before = np.cumsum(count) - count
        first = np.concatenate([[True], parent[1:] != parent[:-1]]) if len(parent) else np.zeros(0, bool)
        offset = before - np.maximum.accumulate(np.where(first, before, 0)) if len(parent) else before
        new_low = self.smaller[symbol] + low - self.begin[symbol]
        return parent, symbol, new_low, new_low + count, offset


def compacted(ids: np.ndarray, kept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``ids`` renumbered to the words that are ``kept`` (by old id), runs of others reduced to one 0; and the new words' old ids."""
    old = np.flatnonzero(kept)
    to = np.zeros(len(kept), np.int64)
    to[old] = np.arange(1, len(old) + 1)
    symbols = to[ids]
    stays = (symbols > 0) | np.concatenate([[True], symbols[:-1] > 0])
    return np.concatenate([[0], symbols[stays], [0]]), np.concatenate([[0], old])


def linked(symbols: np.ndarray, hashes: np.ndarray, two: np.ndarray) -> np.ndarray:
    """The sequence with a 0 wherever two neighbours are no pair that may be frequent; words in no such pair go. ``hashes`` by symbol."""
    passes = (symbols[:-1] > 0) & (symbols[1:] > 0)
    at = np.flatnonzero(passes)
    passes[at] = in_filter(two, pair_hashes(hashes[symbols[at]], hashes[symbols[at + 1]]))
    on, off = np.concatenate([passes, [False]]), np.concatenate([[False], passes])  # a pair begins, or ends, here
    where = np.flatnonzero(on | off)
    size = 1 + ~on[where]  # a 0 after the last of a run
    end = np.cumsum(size)
    out = np.zeros(1 + int(size.sum()), np.int64)
    out[1 + end - size] = symbols[where]
    return out


def pair_hashes(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One hash for each pair of words from the words' hashes."""
    return mix(a * np.uint64(0x9E3779B97F4A7C15) + b)


def in_filter(found: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes a filter of bits (its size a power of two) may hold."""
    place = (hashes & np.uint64(len(found) * 8 - 1)).astype(np.int64)
    return found[place >> 3] >> (place & 7).astype(np.uint8) & 1 == 1


@dataclass
class Pairs:
    """Two-word phrases of a shard: ids and counts, and where each is in the index of the reversed sequence."""

    bits: int
    first: np.ndarray
    second: np.ndarray
    count: np.ndarray
    low: np.ndarray


def pairs(symbols: np.ndarray, words: int) -> Pairs:
    """All pairs of ``words`` symbols: the interval of each symbol, extended to the left in the index of the sequence.

    The reversed sequence has the interval of a symbol at the same place; the offsets of the extensions give the pairs' there.
    """
    bits = max(1, words.bit_length())
    index = Index(symbols, bits)
    low, high = index.smaller[1 : words + 1], index.smaller[2 : words + 2]
    parent, before, left_low, left_high, offset = index.extended(low, high)
    full = before > 0
    parent = parent[full]
    return Pairs(bits, before[full], parent + 1, (left_high - left_low)[full], low[parent] + offset[full])


def word_rows(batches: Iterator[pa.RecordBatch], most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of each shard's words."""
    for shard in shards(batches, most):
        count = np.bincount(shard.ids, minlength=len(shard.words))
        yield shard.hashes()[1:], count[1:]


def pair_rows(batches: Iterator[pa.RecordBatch], most: int, words: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hashes and counts of each shard's pairs of words that may be frequent."""
    for shard in shards(batches, most):
        hashes = shard.hashes()
        symbols, old = compacted(shard.ids, np.concatenate([[False], in_filter(words, hashes[1:])]))
        found, hashed = pairs(symbols, len(old) - 1), hashes[old]
        yield pair_hashes(hashed[found.first], hashed[found.second]), found.count


def phrase_rows(batches: Iterator[pa.RecordBatch], most: int, words: np.ndarray, two: np.ndarray) -> Iterator[pa.RecordBatch]:
    """(lang, phrase, size, n) of each shard: all its words as one row of size 0, and its phrases all parts of which may be frequent.

    Only runs of pairs that may be frequent are indexed. A pair found there is extended to the right in the index of the
    reversed sequence; what comes has two such pairs.
    """
    for shard in shards(batches, most):
        hashes = shard.hashes()
        kept = np.concatenate([[False], in_filter(words, hashes[1:])])
        total = np.bincount(shard.ids, minlength=len(shard.words))
        symbols, old = compacted(shard.ids, kept)
        symbols = linked(symbols, hashes[old], two)
        found = pairs(symbols, len(old) - 1)
        first, second = old[found.first], old[found.second]
        parts = [([old[1:]], total[old[1:]]), ([first, second], found.count)]
        if len(first):
            parent, third, low, high, _ = Index(symbols[::-1], found.bits).extended(found.low, found.low + found.count)
            full = np.flatnonzero(third > 0)
            parts.append(([first[parent[full]], second[parent[full]], old[third[full]]], (high - low)[full]))
        yield batch_of(
            lang=pa.array([shard.language], pa.string()), phrase=pa.array([""], pa.string()), size=pa.array([0], pa.int32()), n=pa.array([int(total[1:].sum())], pa.int64()),
        )
        for columns, n in parts:
            for a in range(0, len(n), ROWS):
                texts = [shard.words.take(pa.array(c[a : a + ROWS])) for c in columns]
                phrase = texts[0] if len(texts) == 1 else pc.binary_join_element_wise(*texts, b" ")
                rows = len(phrase)
                yield batch_of(
                    lang=pa.array([shard.language], pa.string()).take(pa.array(np.zeros(rows, np.int64))), phrase=phrase.cast(pa.string()),
                    size=pa.array(np.full(rows, len(columns), np.int32)), n=pa.array(n[a : a + ROWS].astype(np.int64)),
                )


def frequent_filter(rows: DataFrame, least: int, bits: int) -> np.ndarray:
    """Bits of the hashes whose counts in ``rows`` (h, n) sum to ``least``: built by Spark, 2 ** ``bits`` bits at most reach the driver."""
    place = F.col("h").bitwiseAND((1 << bits) - 1) + 1
    frequent = rows.groupBy("h").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select(place.alias("place"))
    blocks = frequent.groupBy(F.bitmap_bucket_number("place").alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("place")).alias("bits"))
    out = np.zeros((1 << bits) // 8, np.uint8)
    for row in blocks.collect():
        at = (row.block - 1) * len(row.bits)
        out[at : at + len(row.bits)] = np.frombuffer(row.bits, np.uint8)[: len(out)]
    return out


def phrase_counts(docs: DataFrame, least: int = 10, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS) -> DataFrame:
    """(lang, phrase, size, n): how often each phrase of up to three words occurs in a language, if ``least`` times.

    The row of size 0 and phrase "" counts all words of the language. Three passes over the texts, each indexed in shards of
    about ``shard_words`` words of one language:

    1. words and their counts, as hashes; 2. pairs of words that are frequent, as hashes; 3. frequent words, pairs of which
    a filter of the hashes says that they may be frequent, and triples both of whose pairs pass, with their texts.

    A phrase occurs no more often than its parts, so nothing frequent is filtered out; what shares a bit with something
    frequent goes by its exact sum in the end. The filters are of fixed size and the only broadcasts. Equal hashes are
    summed before and after they move, so a hot word or phrase is one row a shard.
    """
    rows = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).alias("text"))
    context = docs.sparkSession.sparkContext
    tidy_shuffles(docs.sparkSession)

    def hashed(batches: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for h, n in batches:
            for a in range(0, len(h), ROWS):
                yield batch_of(h=h[a : a + ROWS].view(np.int64), n=n[a : a + ROWS].astype(np.int64))

    words = context.broadcast(frequent_filter(rows.mapInArrow(lambda b: hashed(word_rows(b, shard_words)), "h long, n long"), least, WORD_BITS))
    two = context.broadcast(frequent_filter(rows.mapInArrow(lambda b: hashed(pair_rows(b, shard_words, words.value)), "h long, n long"), least, PAIR_BITS))
    found = rows.mapInArrow(lambda b: phrase_rows(b, shard_words, words.value, two.value), "lang string, phrase string, size int, n long")
    return found.groupBy("lang", "phrase", "size").agg(F.sum("n").alias("n")).where((F.col("n") >= least) | (F.col("size") == 0))


def collocations(
    docs: DataFrame, least: int = 10, share: int = 50, first: int = 2_000, text_col: str = "text", lang_col: str = "lang", shard_words: int = SHARD_WORDS,
) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the ``first`` phrases of each language whose words belong together most.

    Texts are lower-cased in A-Z, split at ``.,;:!?`` and line ends into pieces and those at spaces and tabs into words. A
    candidate is a phrase of two or three words that occurs ``a >= least`` times inside pieces. Cut in two, its parts occur
    l and r times; the score is floor(10**6 * a * a / (l * r)) of the cut for which that is least, the earliest of equals.
    Candidates inside a longer one that has ``share`` percent of their occurrences are left out. n counts the language's
    words. Order: score, then a, both descending, then the phrase.

    Products are taken in decimals of 38 digits and divided whole, so counts up to 10**16 are exact. Ranks are cut down per
    language and salt first, so no task sorts all of a language's candidates.

    Null texts are empty, a null language is ``und``. Texts without words, languages without candidates and empty tables give
    no rows. Repeated rows count as often as they stand there. Ids and other columns are not read.
    """
    counts = written(phrase_counts(docs, least, text_col, lang_col, shard_words))
    f = counts.where("size > 0").select("lang", "phrase", "n")
    words = F.split("phrase", " ")
    longer = counts.where(F.col("size") == DEPTH).select("lang", "n", F.explode(F.array(F.array_join(F.slice(words, 1, 2), " "), F.array_join(F.slice(words, 2, 2), " "))).alias("phrase"))
    inside = longer.groupBy("lang", "phrase").agg(F.max("n").alias("most"))
    free = counts.where("size > 1").join(inside, ["lang", "phrase"], "left").where(F.col("most").isNull() | (100 * F.col("most") < share * F.col("n")))
    cut = free.select("lang", "phrase", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("size") - 1)).alias("k"), words.alias("w"), "size")
    parts = cut.select("lang", "phrase", "a", "k", F.array_join(F.slice("w", 1, F.col("k")), " ").alias("left"), F.array_join(F.slice("w", F.col("k") + 1, F.col("size") - F.col("k")), " ").alias("right"))
    of = lambda side, name: f.select("lang", F.col("phrase").alias(side), F.col("n").alias(name))
    both = parts.join(of("left", "l"), ["lang", "left"]).join(of("right", "r"), ["lang", "right"])
    exact = {c: F.col(c).cast("decimal(16,0)") for c in "alr"}
    score = F.call_function("div", F.lit(1_000_000).cast("decimal(7,0)") * (exact["a"] * exact["a"]), exact["l"] * exact["r"])
    best = both.withColumn("score", score.cast("long")).groupBy("lang", "phrase", "a").agg(F.min(F.struct("score", "k", "l", "r")).alias("cut"))
    scored = best.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    salt = F.pmod(F.xxhash64("phrase"), F.lit(RANK_SALTS))
    early = scored.withColumn("salt", salt).withColumn("rank", F.row_number().over(Window.partitionBy("lang", "salt").orderBy(*order))).where(F.col("rank") <= first)
    ranked = early.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= first)
    totals = counts.where("size = 0").select("lang", "n")
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
