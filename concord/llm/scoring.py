"""LM scoring by masked pseudo-likelihood: a bidirectional window network predicts every token from both sides."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast, TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import batch_of, durable, sliced, written

SIDE = 64  # the least side: a token is one of ``side`` members of one of ``side`` classes
TOKENS = SIDE * SIDE
COMMON = 3_072  # words with a token of their own at least; the others share the rest by hash, each with its exact share of it
LEAST, OWN = 10_000, 262_144  # words seen so often have their own token too, up to what a task's memory holds
HEAD = 200_000  # words whose exact shares are broadcast; those of the others are joined
FIXED = 1 << 30  # logarithms are summed as whole numbers of this part of one, so that their order does not matter
REACH = (-2, -1, 1, 2)
BATCH, SCORED = 8_192, 8_192
BLOCK, FAN = 4_096, 64  # parameters of a row, rows averaged at once
READ = 8 << 20  # bytes of texts whose words are looked up at once, or one text
PIECES = 16  # batches, of 1,000 rows at most, whose words are looked up at once


@dataclass
class Network:
    """Parameters: context vectors for each token and offset, and the outputs for the class and for the member of a class.

    h = tanh(b + sum of the context tokens' vectors); P(token) = softmax(classes h)[class] * softmax(members_of_class h)[member].
    Both softmaxes are over ``side`` values, so every probability is normalised at the cost of two short rows. An output's
    bias is stored behind its weights and h ends with a one, so products add the bias.
    """

    flat: np.ndarray
    width: int
    side: int = SIDE

    @classmethod
    def shapes(cls, width: int, side: int = SIDE) -> list[tuple[int, ...]]:
        return [(side * side + 1, len(REACH), width), (width,), (side, width + 1), (side, side, width + 1)]

    @classmethod
    def start(cls, width: int, counts: np.ndarray, seed: int = 11) -> Network:
        """Small random vectors; outputs begin at the tokens' shares of the corpus."""
        draw, side = np.random.default_rng(seed), math.isqrt(len(counts))
        net = cls(np.zeros(sum(int(np.prod(s)) for s in cls.shapes(width, side)), np.float32), width, side)
        context, _, top, top_bias, members, member_bias = net.parts()
        context[:] = draw.standard_normal(context.shape) * 0.1
        top[:] = draw.standard_normal(top.shape) * 0.1
        members[:] = draw.standard_normal(members.shape) * 0.1
        share = (counts.reshape(side, side) + 0.5) / (counts.sum() + 0.5 * side * side)
        top_bias[:] = np.log(share.sum(1))
        member_bias[:] = np.log(share / share.sum(1, keepdims=True))
        return net

    def stored(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        """Context vectors by token, their bias, and the outputs with their biases behind them."""
        flat, out, at = self.flat if flat is None else flat, [], 0
        for shape in self.shapes(self.width, self.side):
            n = int(np.prod(shape))
            out.append(flat[at : at + n].reshape(shape))
            at += n
        return out

    def parts(self, flat: np.ndarray | None = None) -> list[np.ndarray]:
        context, bias, top, members = self.stored(flat)
        return [context.swapaxes(0, 1), bias, top[:, :-1], top[:, -1], members[..., :-1], members[..., -1]]

    def hidden(self, tokens: np.ndarray, at: np.ndarray) -> np.ndarray:
        """h of each place, and a one."""
        context, bias, *_ = self.stored()
        total, lines = np.broadcast_to(bias, (len(at), self.width)).copy(), context.reshape(-1, self.width)
        for i, offset in enumerate(REACH):
            total += lines.take(tokens.take(at + offset) * len(REACH) + i, axis=0)
        h = np.ones((len(at), self.width + 1), self.flat.dtype)
        np.tanh(total, out=h[:, :-1])
        return h

    @staticmethod
    def shares(logits: np.ndarray, picked: np.ndarray, scale: np.float32 | None) -> np.ndarray:
        """The logarithm of the picked one of each row's softmax; with ``scale``, ``logits`` become its gradients times that."""
        if logits.size and logits.max() > 60:
            np.minimum(logits, 60, out=logits)  # keeps float32 finite; nothing near it is ever learnt
        line, where = logits.reshape(-1), np.arange(len(picked)) * logits.shape[1] + picked
        chosen = line.take(where)
        np.exp(logits, out=logits)
        total = logits @ np.ones(logits.shape[1], logits.dtype)
        if scale is not None:
            logits *= (scale / total)[:, None]
            line[where] -= scale
        return chosen - np.log(total)

    def predict(self, tokens: np.ndarray, at: np.ndarray, step: object = None) -> np.ndarray:
        """The log-probability of each token ``tokens[at]`` given those around it; with ``step``, also the gradients to it."""
        logs, found = self.passed(tokens, at, step is not None)
        if found:
            used, g_context, others = found
            gradient = np.zeros_like(self.flat)
            self.stored(gradient)[0][used] = g_context
            gradient[-len(others) :] = others
            step(gradient)  # type: ignore[operator]
        return logs

    def passed(self, tokens: np.ndarray, at: np.ndarray, back_too: bool) -> tuple[np.ndarray, tuple[np.ndarray, ...] | None]:
        """The log-probabilities; with ``back_too`` also the tokens around, the gradients of their context vectors and of
        all other parameters. Those of other tokens' vectors are nothing, so a step costs the same in a large vocabulary."""
        context, bias, top, members = self.stored()
        side, target = self.side, tokens.take(at)
        group = (target // side).astype(np.uint16)
        order = np.argsort(group, kind="stable")
        at, group, target = at.take(order), group.take(order).astype(np.int64), target.take(order)
        scale = np.float32(1 / len(at)) if back_too else None
        h = self.hidden(tokens, at)
        share = h @ top.T
        log_top = self.shares(share, group, scale)
        cut = np.searchsorted(group, np.arange(side + 1)).tolist()
        full = [(g, cut[g], cut[g + 1]) for g in range(side) if cut[g] < cut[g + 1]]
        inner = np.empty((len(at), side), h.dtype)
        for g, a, b in full:
            np.matmul(h[a:b], members[g].T, out=inner[a:b])
        log_member = self.shares(inner, target - group * side, scale)
        logs = np.empty(len(at), np.float64)
        logs[order] = log_top.astype(np.float64) + log_member
        if not back_too:
            return logs, None
        others = np.zeros(len(self.flat) - context.size, h.dtype)
        g_bias, g_top, g_members = others[: bias.size], others[bias.size :][: top.size].reshape(top.shape), others[bias.size + top.size :].reshape(members.shape)
        before, ones = h[:, :-1], np.ones(len(at), h.dtype)  # products are quicker with whole lanes, so the biases come apart
        back, more = share @ top[:, :-1], np.empty((len(at), self.width), h.dtype)
        g_top[:, :-1], g_top[:, -1] = share.T @ before, ones @ share
        for g, a, b in full:
            np.matmul(inner[a:b], members[g, :, :-1], out=more[a:b])
            g_members[g, :, :-1], g_members[g, :, -1] = inner[a:b].T @ before[a:b], ones[a:b] @ inner[a:b]
        back += more
        back *= 1 - before * before
        back = back.astype(np.float64)
        g_bias[:] = back.sum(0)
        around, seen, line_of = [tokens.take(at + offset) for offset in REACH], np.zeros(len(context), bool), np.empty(len(context), np.int64)
        for token in around:
            seen[token] = True
        used = np.flatnonzero(seen)
        line_of[used] = np.arange(len(used))
        cells, g_context = np.arange(len(used) * self.width).reshape(-1, self.width), np.empty((len(used), *context.shape[1:]), h.dtype)
        for i, token in enumerate(around):
            where = cells.take(line_of.take(token), axis=0)
            g_context[:, i] = np.bincount(where.reshape(-1), back.reshape(-1), cells.size).reshape(cells.shape)
        return logs, (used, g_context, others)

    def descent(self, rate: float) -> object:
        """AdaGrad on the network's own parameters: a function that learns from a batch."""
        power = np.full_like(self.flat, 1e-8)
        context, context_power = self.stored()[0], self.stored(power)[0]
        rest, rest_power = self.flat[context.size :], power[context.size :]

        def change(gradient: np.ndarray, power: np.ndarray) -> np.ndarray:
            """What to take off; uses ``gradient`` up."""
            root = np.sqrt(power)
            np.multiply(gradient, np.float32(rate), out=gradient)
            return np.divide(gradient, root, out=gradient)

        def learn(tokens: np.ndarray, at: np.ndarray) -> None:
            used, g_context, others = self.passed(tokens, at, True)[1]
            held = context_power.take(used, axis=0)
            held += g_context * g_context
            context_power[used] = held
            context[used] -= change(g_context, held)
            np.add(rest_power, others * others, out=rest_power)
            np.subtract(rest, change(others, rest_power), out=rest)

        return learn


def room(common: dict[bytes, int]) -> tuple[int, int]:
    """(first shared token, side) for these words: a quarter of all tokens is left for the others."""
    own = max(COMMON, len(common))
    return own, max(SIDE, math.isqrt(own * 4 // 3 - 1) + 1)


class Numbering(dict):
    """Token numbers of words: the commonest have their own, the others share the rest by hash and are remembered a while."""

    def __init__(self, common: dict[bytes, int], most: int = 300_000) -> None:
        import xxhash

        super().__init__(common)
        self.own, side = room(common)
        self.common, self.digest, self.most, self.shared = common, xxhash.xxh3_64_intdigest, most + len(common), side * side - self.own

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.most:
            self.clear()
            self.update(self.common)
        token = self[word] = self.own + self.digest(word, 3) % self.shared
        return token

    def rare(self, words: list[bytes]) -> np.ndarray:
        """The tokens of words that have none of their own, which are not remembered."""
        digest = self.digest
        hashes = np.fromiter([digest(w, 3) for w in words], np.uint64, len(words))
        return (hashes % np.uint64(self.shared)).astype(np.int64) + self.own

    def of(self, text: bytes | None) -> np.ndarray:
        words = text.lower().split() if text else []
        return np.fromiter(map(self.__getitem__, words), np.int64, len(words))


def padded(texts: list[np.ndarray], blank: int = TOKENS) -> tuple[np.ndarray, np.ndarray]:
    """All texts' tokens in a row, two pads around each, and the places of the tokens."""
    pad = max(map(abs, REACH))
    size = np.array([len(t) for t in texts], np.int64)
    start = np.cumsum(size + 2 * pad) - size - pad
    flat = np.full(int((size + 2 * pad).sum()), blank, np.int64)
    for a, t in zip(start, texts):
        flat[a : a + len(t)] = t
    shift = np.repeat(start - (np.cumsum(size) - size), size)
    return flat, np.arange(int(size.sum())) + shift


def parted(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[pa.RecordBatch]:
    """Rows in parts of at most READ bytes of texts in ``column``, or of one row; a part may hold rows of several batches."""
    held: list[pa.RecordBatch] = []
    size = 0
    for batch in sliced(batches):
        upto = np.cumsum(pc.binary_length(batch.column(column)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < batch.num_rows:
            before = int(upto[at - 1]) if at else 0
            end = int(np.searchsorted(upto, before + READ - size, "right"))
            if held and (end <= at or len(held) >= PIECES):  # the next row is too much for this part
                yield pa.concat_batches(held)
                held, size = [], 0
                continue
            end = max(at + 1, end)
            held.append(batch.slice(at, end - at))
            size, at = size + int(upto[end - 1]) - before, end
    if held:
        yield pa.concat_batches(held)


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """All words of ``texts`` in a row, A-Z lower-cased, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts))
    words, sizes = lists.flatten(), pc.list_value_length(lists).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    full = pc.greater(pc.binary_length(words), 0)  # white space at an end leaves an empty one
    upto = np.concatenate([[0], np.cumsum(full.to_numpy(zero_copy_only=False))])
    ends = np.cumsum(sizes)
    return words.filter(full).cast(pa.binary()), upto[ends] - upto[ends - sizes]


class Reader:
    """Tokens of texts: words of the head by one lookup of a part's words, the distinct others by their hash.

    The head holds all words with a token of their own.
    """

    def __init__(self, head: list[bytes], token_of: np.ndarray, common: dict[bytes, int]) -> None:
        self.head, self.numbering = pa.array(head, pa.binary()), Numbering(common)
        self.token_of = np.append(token_of, 0)  # the last is at -1

    def read(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, pa.Array]:
        """Words of each text; of each word its token and place in the head, -1 outside; the words outside, each as a number
        in the list of distinct ones; that list."""
        words, sizes = words_of(texts)
        place = pc.index_in(words, value_set=self.head).fill_null(-1).to_numpy(zero_copy_only=False)
        outside = np.flatnonzero(place < 0)
        other = words.take(pa.array(outside)).dictionary_encode()
        which, distinct = other.indices.to_numpy(zero_copy_only=False), other.dictionary
        tokens = self.token_of.take(place)
        tokens[outside] = self.numbering.rare(distinct.to_pylist())[which]
        return sizes, tokens, place, outside, which, distinct


def word_counts(docs: DataFrame) -> DataFrame:
    """(word, n) of every word of all texts, exact. Each task sends its own sums; nothing reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.Table] = []
        rows = 0

        def summed() -> pa.Table:
            return pa.concat_tables(held).group_by("word", use_threads=False).aggregate([("n", "sum")]).rename_columns(["word", "n"])

        for batch in parted(batches, 0):
            found = words_of(batch.column(0))[0].value_counts()
            held.append(pa.table({"word": found.field("values"), "n": found.field("counts")}))
            rows += len(found)
            if rows > 2_000_000:
                held = [summed()]
                rows = held[0].num_rows
            if rows > 1_000_000 and len(held) == 1:
                yield from held.pop().to_batches(50_000)
                rows = 0
        if held:
            yield from summed().to_batches(50_000)

    return written(docs.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")))


def seen_often(words: DataFrame, most: int) -> int:
    """The least n for which no more than ``most`` words are seen n times or more."""
    n, total = 1, 0
    for r in sorted(words.groupBy("n").count().collect(), key=lambda r: -r.n):
        total += r["count"]
        if total > most:
            n = r.n + 1
            break
    return n


def common_words(docs: DataFrame, most: int = COMMON, words: DataFrame | None = None, least: int = LEAST) -> tuple[dict[bytes, int], np.ndarray]:
    """The words with a token of their own, numbered in order, and the count of every token. Counts are of all texts.

    They are the ``most`` commonest, and all that are seen ``least`` times (OWN words at the outside), so that their number
    and the network's side grow with the corpus. The driver receives them and the sums of the others' hash classes.
    """
    words = word_counts(docs) if words is None else words
    often = words.where(F.col("n") >= max(least, seen_often(words, OWN)))
    top = often.collect() if often.count() > most else words.orderBy(F.desc("n"), "word").limit(most).collect()
    common = {bytes(r.word): i for i, r in enumerate(sorted(top, key=lambda r: (-r.n, bytes(r.word))))}
    _, side = room(common)
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, numbering = np.zeros(side * side, np.int64), Numbering(shared.value)
        for batch in sliced(batches):
            said = batch.column(0).to_pylist()
            tokens = np.fromiter((shared.value.get(w, -1) for w in said), np.int64, len(said))
            rare = np.flatnonzero(tokens < 0)
            tokens[rare] = numbering.rare([said[i] for i in rare])
            np.add.at(total, tokens, batch.column(1).to_numpy())
        used = np.flatnonzero(total)
        yield batch_of(token=used, n=total[used])

    counts = np.zeros(side * side, np.float64)
    for r in words.mapInArrow(classes, "token long, n long").groupBy("token").agg(F.sum("n").alias("n")).collect():
        counts[r.token] = r.n
    return common, counts


def averaged(parts: DataFrame) -> np.ndarray:
    """The mean of all tasks' parameters by their number of tokens: FAN rows of a block at a time, level by level."""

    def mean(table: pa.Table) -> pa.Table:
        weight = np.array(table.column("weight").to_pylist(), np.float64)
        rows = np.stack([np.frombuffer(x, np.float32) for x in table.column("values").to_pylist()])
        total = (rows * (weight / weight.sum())[:, None]).sum(0).astype(np.float32)
        return pa.table({"block": table.column("block")[:1], "part": pa.array([table.column("group")[0].as_py()], pa.int64()), "weight": [weight.sum()], "values": pa.array([total.tobytes()], pa.binary())})

    most = parts.agg(F.max("part")).first()[0]
    while most is not None and most >= 0:
        most = most // FAN
        parts = parts.withColumn("group", F.floor(F.col("part") / FAN)).groupBy("block", "group").applyInArrow(mean, "block long, part long, weight double, values binary")
        if most == 0:
            break
    return np.concatenate([np.frombuffer(r["values"], np.float32) for r in sorted(parts.collect(), key=lambda r: r.block)] or [np.empty(0, np.float32)])


def trained(
    docs: DataFrame, width: int = 16, rate: float = 0.08, rounds: int = 2, counted: tuple[dict[bytes, int], np.ndarray] | None = None,
    known: Broadcast | None = None,
) -> tuple[dict[bytes, int], Network]:
    """The network, from every token of every document once.

    A round takes the documents of one hash class. Each task trains a copy in numpy on its texts, batch by batch, from
    the parameters of the round before; then the copies are averaged by their numbers of tokens. The order in which a task
    reads its texts is part of the result: the same table, split alike, gives the same network. ``known`` is a ``head_of``; it
    spares looking most words up one by one and changes no token.
    """
    spark = docs.sparkSession
    common, counts = counted or common_words(docs)
    net = Network.start(width, counts)
    side = net.side
    known = known or spark.sparkContext.broadcast(([*common], np.arange(len(common)), None))
    words = spark.sparkContext.broadcast(common)
    for r in range(rounds):
        begin = spark.sparkContext.broadcast(net.flat)

        def run(batches: Iterator[pa.RecordBatch], begin=begin) -> Iterator[pa.RecordBatch]:
            net, reader, seen = Network(begin.value.copy(), width, side), Reader(*known.value[:2], words.value), 0
            learn_batch = net.descent(rate)
            held: list[np.ndarray] = []
            size = 0

            def learn() -> int:
                flat, at = padded(held, side * side)
                for i in range(0, len(at), BATCH):
                    learn_batch(flat, at[i : i + BATCH])
                return len(at)

            for batch in parted(batches, 0):
                sizes, said, *_ = reader.read(batch.column(0))
                for tokens in np.split(said, np.cumsum(sizes)[:-1]):
                    if len(tokens):
                        held.append(tokens)
                        size += len(tokens)
                    if size >= 8 * BATCH:
                        seen += learn()
                        held, size = [], 0
            seen += learn() if held else 0
            if seen:
                blocks = [net.flat[i : i + BLOCK].tobytes() for i in range(0, len(net.flat), BLOCK)]
                n = len(blocks)
                yield batch_of(block=np.arange(n), part=np.full(n, TaskContext.get().partitionId()), weight=np.full(n, float(seen)), values=pa.array(blocks, pa.binary()))

        mine = docs.where(F.pmod(F.xxhash64("doc_id"), F.lit(rounds)) == r).select("text")
        parts = durable(mine.mapInArrow(run, "block long, part long, weight double, values binary"))
        flat = averaged(parts)
        net = Network(flat, width, side) if len(flat) else net
    return common, net


def head_of(words: DataFrame, common: dict[bytes, int], counts: np.ndarray, most: int) -> Broadcast:
    """Broadcast (words, tokens, logarithms of their shares of their tokens) of the words with their own token and of those seen most often."""
    rows = [(bytes(r.word), r.n) for r in words.where(F.col("n") >= seen_often(words, most)).collect()]
    rows = sorted((w, n) for w, n in rows if w not in common)
    head, numbering = [*common, *(w for w, _ in rows)], Numbering(common)
    tokens = np.array([numbering[w] for w in head], np.int64)
    logs = np.zeros(len(head))
    logs[len(common) :] = np.log(np.array([n for _, n in rows], np.float64) / counts[tokens[len(common) :]])
    return words.sparkSession.sparkContext.broadcast((head, tokens, logs))


def scores(docs: DataFrame, width: int = 16, rounds: int = 2, id_col: str = "doc_id", text_col: str = "text", head: int = HEAD) -> DataFrame:
    """(doc_id, n_tokens, log_likelihood, per_token) of every row of ``docs``.

    Words (ASCII letters lower-cased) are predicted by the two before and the two after, and the summed log-probabilities
    are the text's score. A word's probability is the network's of its token, times the word's exact share of the
    occurrences of that token: 1 for words with a token of their own. Vocabulary, shares and network are of the whole corpus
    (``common_words``, ``trained``); the counts of all words stay a table, so the model grows with the corpus.

    The driver and the workers receive the network, its words and the shares of the ``head`` words seen most often. The
    other words of a text, each once with its number, meet their counts by a join; the words with their own token, and so
    all frequent ones, never take part in it. What moves besides are sums of words and the tasks' networks.

    Null, empty and wordless texts have no tokens, likelihood 0 and no mean. Repeated rows and ids get a row each, and
    count in training each time. Other columns are not read. An empty table gives an empty table. A text of any length is
    scored whole, in slices of SCORED tokens.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    words = word_counts(rows)
    common, counts = common_words(rows, words=words)
    known = head_of(words, common, counts, head)
    _, net = trained(rows, width, rounds=rounds, counted=(common, counts), known=known)
    context, side = docs.sparkSession.sparkContext, net.side
    flat = context.broadcast(net.flat)
    shared = context.broadcast((common, np.log(np.maximum(counts, 1))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (common, log_total), (head, token_of, log_of) = shared.value, known.value
        log_of = np.append(log_of, 0)  # the last is at -1
        net, reader, row = Network(flat.value, width, side), Reader(head, token_of, common), TaskContext.get().partitionId() << 40
        for batch in parted(batches, 1):
            sizes, tokens, place, outside, which, distinct = reader.read(batch.column(1))
            n = len(sizes)
            text = np.repeat(np.arange(n), sizes)
            share = log_of.take(place)
            share[outside] = -log_total[tokens[outside]]
            line, spots = padded(np.split(tokens, np.cumsum(sizes)[:-1]), side * side)
            logs = np.concatenate([net.predict(line, spots[i : i + SCORED]) for i in range(0, len(spots), SCORED)] or [np.empty(0)])
            yield batch_of(
                row=pa.array(range(row, row + n), pa.int64()), doc_id=batch.column(0), n_tokens=pa.array(sizes, pa.int64()),
                total=pa.array(np.bincount(text, logs + share, n), pa.float64()), word=pa.nulls(n, pa.binary()), n=pa.nulls(n, pa.int64()),
            )
            far, times = np.unique(text[outside] * len(distinct) + which, return_counts=True)
            for at in range(0, len(far), 10_000):
                of, m = far[at : at + 10_000], len(far[at : at + 10_000])
                yield batch_of(
                    row=pa.array(row + of // len(distinct), pa.int64()), doc_id=pa.nulls(m, batch.column(0).type), n_tokens=pa.nulls(m, pa.int64()),
                    total=pa.nulls(m, pa.float64()), word=distinct.take(pa.array(of % len(distinct))), n=pa.array(times[at : at + m], pa.int64()),
                )
            row += n

    kind = docs.schema[id_col].dataType.simpleString()
    made = written(rows.mapInArrow(run, f"row long, doc_id {kind}, n_tokens long, total double, word binary, n long"))
    log = F.round(F.ln(words["n"].cast("double")) * FIXED).cast("long")
    far = made.where("word IS NOT NULL").select("row", "word", F.col("n").alias("times")).join(words, "word")
    far = far.groupBy("row").agg(F.sum(F.col("times") * log).alias("logs"))
    total = F.col("total") + F.coalesce(F.col("logs") / F.lit(float(FIXED)), F.lit(0.0))
    out = made.where("word IS NULL").join(far, "row", "left").select("doc_id", "n_tokens", total.alias("log_likelihood"))
    return out.withColumn("per_token", F.when(F.col("n_tokens") > 0, F.col("log_likelihood") / F.col("n_tokens")))
