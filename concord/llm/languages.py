"""Language identification by cross-parsing: suffix automata of labelled text, longest matches, fewest normalised phrases."""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from concord.llm.common import batch_of, durable, sliced

#: Languages of one pass over the texts, bytes of the sample of each, characters of one sampled place.
LANGUAGES, SAMPLE, PLACE = 8, 32_768, 256
#: A text is parsed in stretches of so many symbols, each from a fresh phrase; so many stretches go side by side.
STRETCH, LANES = 2_048, 1_024
#: What stays of a lower-cased text's UTF-8: letters a to z and all bytes of other alphabets.
KEPT = bytes(c if 97 <= c <= 122 or c >= 128 else 32 for c in range(256))
#: The language of a text without a letter.
NONE = "und"


def symbols(text: str | None) -> bytes:
    """The symbols of a text: its UTF-8 in lower case, one space for each run of other ASCII characters and at both ends."""
    words = (text or "").lower().encode().translate(KEPT).split()
    return b" " + b" ".join(words) + b" " if words else b""


def has_letter(text: str | None, parsed: bytes) -> bool:
    """Whether a text holds a letter of any alphabet; its ``symbols`` settle all but texts without a to z."""
    return bool(parsed) and (not parsed.isascii() and any(map(str.isalpha, text or "")) or any(97 <= c <= 122 for c in parsed))


def automaton(sample: bytes, width: int) -> np.ndarray:
    """The suffix automaton of a sequence of codes below ``width``: a row of next states for each state, 0 for none."""
    link, length, step, blank = [-1], [0], array("i", bytes(4 * width)), array("i", bytes(4 * width))
    last = 0
    for code in sample:
        new = len(link)
        link.append(0)
        length.append(length[last] + 1)
        step.extend(blank)
        at = last
        while at >= 0 and not step[at * width + code]:
            step[at * width + code] = new
            at = link[at]
        if at >= 0:
            old = step[at * width + code]
            if length[old] == length[at] + 1:
                link[new] = old
            else:
                twin = len(link)
                link.append(link[old])
                length.append(length[at] + 1)
                step.extend(step[old * width : (old + 1) * width])
                while at >= 0 and step[at * width + code] == old:
                    step[at * width + code] = twin
                    at = link[at]
                link[old] = link[new] = twin
        last = new
    return np.frombuffer(step, np.int32).reshape(-1, width)


@dataclass
class Languages:
    """The automata of some languages over one alphabet, as one table.

    ``step[state + code]`` is the next state, a multiple of the alphabet's size. Where a language's sample does not go on it
    is the complement of the state in which the next phrase has begun with that code, or of the language's start if its
    sample does not hold the code. Every step from a start begins a phrase, so all phrases are the negative steps.
    """

    names: list[str]
    codes: bytes
    step: np.ndarray
    start: np.ndarray
    price: np.ndarray

    @classmethod
    def of(cls, samples: dict[str, bytes]) -> Languages:
        """``samples``: the symbols of each language. The last code stands for all symbols that no sample holds."""
        held = sorted(set().union(*samples.values()))
        width = len(held) + 1
        codes = bytearray([len(held)]) * 256
        for code, symbol in enumerate(held):
            codes[symbol] = code
        tables, start, at = [], [], 0
        for sample in samples.values():
            own = automaton(sample.translate(bytes(codes)), width).astype(np.int64)
            begun = ~np.where(own[0] > 0, (own[0] + at) * width, at * width)
            table = np.where(own > 0, (own + at) * width, begun)
            table[0] = begun
            tables.append(table.astype(np.int32).ravel())
            start.append(at * width)
            at += len(own)
        price = np.log2([len(s) + 1.0 for s in samples.values()])
        return cls(list(samples), bytes(codes), np.concatenate(tables), np.array(start, np.int32), price)

    def phrases(self, texts: list[bytes]) -> np.ndarray:
        """How many phrases each of ``texts`` has in each language.

        A phrase is the longest match with the language's sample, or a symbol that it does not hold; no phrase goes
        beyond a stretch. All stretches and languages step together, stretches in order of their length.
        """
        out = np.zeros((len(self.names), len(texts)), np.int64)
        parts = [(len(text[a : a + STRETCH]), i, a) for i, text in enumerate(texts) for a in range(0, len(text), STRETCH)]
        parts.sort(key=lambda p: -p[0])
        coded = [text.translate(self.codes) for text in texts]
        for first in range(0, len(parts), LANES):
            block = parts[first : first + LANES]
            sizes = np.array([n for n, _, _ in block])
            rows = np.zeros((len(block), int(sizes[0])), np.uint8)
            for row, (n, i, a) in zip(rows, block):
                row[:n] = np.frombuffer(coded[i], np.uint8, n, a)
            by_step = np.ascontiguousarray(rows.T)
            live = np.searchsorted(-sizes, -np.arange(int(sizes[0])), "left")  # stretches longer than the steps taken
            state = np.repeat(self.start[:, None], len(block), 1)
            count = np.zeros(state.shape, np.int32)
            for codes, n in zip(by_step, live.tolist()):
                found = self.step.take(state[:, :n] + codes[:n])
                ends = found >> 31
                count[:, :n] -= ends
                state[:, :n] = found ^ ends
            np.add.at(out.T, np.array([i for _, i, _ in block]), count.T)
        return out.T

    def bits(self, texts: list[bytes]) -> np.ndarray:
        """Bits a text costs in each language: each phrase is a place in its sample."""
        return self.phrases(texts) * self.price


def _labelled(docs: DataFrame, learn: Column, id_col: str, text_col: str, label_col: str) -> DataFrame:
    """(language, key, text) of the rows to learn from. ``key`` deals rows out evenly; rows of one id and text share it."""
    rows = docs.where(learn & F.col(label_col).isNotNull())
    key = F.pmod(F.xxhash64(F.col(id_col).cast("string"), F.col(text_col)), F.lit(1 << 53))
    return rows.select(F.col(label_col).cast("string").alias("language"), key.alias("key"), F.col(text_col).alias("text"))


def samples(rows: DataFrame, block: list[Row], sample: int = SAMPLE) -> dict[str, bytes]:
    """The symbols learnt of each language of ``block`` (rows of language and n), at most ``sample`` bytes and one place each.

    Rows whose key is under a bound that lets about four times the needed rows through are reduced to one place of PLACE
    characters each, dealt by their key; per language the first in order of the key are taken. So what is shuffled and
    collected is bounded by the parameters, however large the table.
    """
    most = -(-sample // PLACE)
    under = F.lit(False)
    for row in block:
        under |= (F.col("language") == row.language) & (F.col("key") < int(min(1.0, 4 * most / row.n) * (1 << 53)))
    begin = F.pmod("key", F.greatest(F.length("text") - PLACE, F.lit(0)) + 1).cast("int") + 1
    places = rows.where("text IS NOT NULL").where(under).select("language", "key", F.substring("text", begin, F.lit(PLACE)).alias("place"))
    one = places.groupBy("language", "key").agg(F.min("place").alias("place"))
    ranked = one.withColumn("rank", F.row_number().over(Window.partitionBy("language").orderBy("key"))).where(F.col("rank") <= 4 * most)
    held = {row.language: bytearray() for row in block}
    for row in sorted(ranked.collect(), key=lambda r: (r.language, r.rank)):
        if len(held[row.language]) < sample:
            held[row.language] += symbols(row.place)
    return {language: bytes(x) for language, x in sorted(held.items()) if x}


def _parsed(rows: DataFrame, model: object) -> DataFrame:
    """``rows`` (doc_id, held_out, text, lang, bits, mass) with what the languages of a pass change of the last three.

    ``bits`` is the least cost so far; ``mass`` sums two to the power of minus what each language costs more than that.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Languages = model.value  # type: ignore[attr-defined]
        for batch in sliced(batches):
            texts = batch.column("text").to_pylist()
            parsed = [symbols(t) for t in texts]
            lettered = np.array([has_letter(t, p) for t, p in zip(texts, parsed)], bool)
            bits = found.bits(parsed)
            best = bits.argmin(1)  # the first of equals: names are in order
            least = bits[np.arange(len(texts)), best]
            mass = np.exp2(least[:, None] - bits).sum(1)
            old_lang = batch.column("lang").to_pylist()
            old_bits = batch.column("bits").to_numpy(zero_copy_only=False)
            old_mass = batch.column("mass").to_numpy(zero_copy_only=False)
            better = least < old_bits
            new_bits = np.minimum(least, old_bits)
            whole = mass * np.exp2(new_bits - least) + np.where(old_mass > 0, old_mass * np.exp2(new_bits - np.where(old_mass > 0, old_bits, new_bits)), 0.0)
            lang = [found.names[b] if up else old for b, up, old in zip(best.tolist(), better.tolist(), old_lang)]
            yield batch_of(
                doc_id=batch.column("doc_id"), held_out=batch.column("held_out"), text=batch.column("text"),
                lang=pa.array([x if ok else None for x, ok in zip(lang, lettered.tolist())], pa.string()),
                bits=np.where(lettered, new_bits, np.inf), mass=np.where(lettered, whole, 0.0),
            )

    return rows.mapInArrow(run, rows.schema)


def predicted(
    docs: DataFrame, held_out: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", languages: int = LANGUAGES, sample: int = SAMPLE,
) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every row of ``docs``; labels of rows that are ``held_out`` are never read.

    Learnt is a suffix automaton of a bounded sample (``sample`` bytes) of each language's texts. A text is cross-parsed by
    each: from its begin, the longest match with the sample is a phrase, then the next. Phrases times the bits that name a
    place in the sample are a language's cost, the least wins, equal costs go to the language first in order. The score is
    the winner's share if each bit halves a language's odds.

    The texts are parsed whole, in stretches of STRETCH symbols. Languages are dealt with ``languages`` at a time, each pass
    with one broadcast of at most that many automata (an automaton has at most two states a byte and a state a column for
    each byte value in use), so neither the driver nor a worker grows with the number of languages or rows. No shuffle but
    that of the sample.

    Null texts and texts without a letter get the language ``und`` and score 0, as do all if nothing can be learnt. A null
    ``held_out`` counts as false, but such rows are not learnt from. Repeated ids get a row each; rows of one id and text
    are learnt once. Other columns are not read, so their names may clash. An empty table gives an empty table.
    """
    labelled = _labelled(docs, ~held_out, id_col, text_col, label_col)
    counts = durable(labelled.groupBy("language").agg(F.count("*").alias("n")))
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(held_out, F.lit(False)).alias("held_out"), F.col(text_col).alias("text"),
        F.lit(None).cast("string").alias("lang"), F.lit(float("inf")).alias("bits"), F.lit(0.0).alias("mass"),
    )
    block = counts.orderBy("language").limit(languages).collect()
    while block:
        learnt = samples(labelled, block, sample)
        if learnt:
            rows = _parsed(rows, docs.sparkSession.sparkContext.broadcast(Languages.of(learnt)))
        block = counts.where(F.col("language") > block[-1].language).orderBy("language").limit(languages).collect()
    return rows.select("doc_id", "held_out", F.coalesce("lang", F.lit(NONE)).alias("lang_pred"), F.when(F.col("lang").isNotNull(), 1 / F.col("mass")).otherwise(0.0).alias("score"))
