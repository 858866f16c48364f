"""Token counts of whole texts by byte-pair merging with a heap and a linked list."""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import types
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import batch_of, sliced

#: The public pattern that splits text before byte-level merges.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def byte_symbols() -> list[str]:
    """The printable character that byte-level vocabularies write for each byte: itself if printable, else the next free one from 256 on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    free = iter(range(256, 512))
    return [chr(b if b in printable else next(free)) for b in range(256)]


def read_vocabulary(path: str) -> dict:
    """Ranks of the merges and the added tokens of a byte-level BPE file.

    Symbols are numbered, bytes first: ``ranks[left, right]`` is a pair's rank and ``merged[rank]`` what it becomes.
    """
    with open(path, encoding="utf-8") as file:
        spec = json.load(file)
    ids = {s: b for b, s in enumerate(byte_symbols())}
    ranks: dict[tuple[int, int], int] = {}
    merged: list[int] = []
    for rank, pair in enumerate(spec["model"]["merges"]):
        left, right = pair if isinstance(pair, list) else pair.split(" ")
        merged.append(ids.setdefault(left + right, len(ids)))
        ranks.setdefault((ids[left], ids[right]), rank)
    return {"ranks": ranks, "merged": merged, "added": [t["content"] for t in spec.get("added_tokens", [])]}


def count_piece(piece: bytes, ranks: dict[tuple[int, int], int], merged: list[int]) -> int:
    """Symbols left of one piece: repeatedly pop the adjacent pair of lowest rank (leftmost first) and join it.

    A heap entry is rank and place in one int. Symbols are a linked list; one that was joined to its left is -1.
    An entry whose place now starts a pair of another rank, or none, is out of date and passed over.
    """
    get = ranks.get
    symbols = list(piece)
    n = left = len(symbols)
    heap = [rank << 32 | i for i, pair in enumerate(zip(symbols, symbols[1:])) if (rank := get(pair)) is not None]
    if not heap:
        return n
    heapq.heapify(heap)
    pop, push = heapq.heappop, heapq.heappush
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    symbols.append(-1)
    while heap:
        entry = pop(heap)
        i, rank = entry & 0xFFFFFFFF, entry >> 32
        j = after[i]
        if get((symbols[i], symbols[j])) != rank:
            continue
        symbol = symbols[i] = merged[rank]
        symbols[j] = -1
        left -= 1
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (rank := get((symbol, symbols[k]))) is not None:
                push(heap, rank << 32 | i)
        h = before[i]
        if h >= 0 and (rank := get((symbols[h], symbol))) is not None:
            push(heap, rank << 32 | h)
    return left


def worker_memory(name: str) -> dict:
    """What this Python worker process keeps from one task to the next under ``name``."""
    return sys.modules.setdefault(f"concord_worker_{name}", types.ModuleType(name)).__dict__.setdefault("kept", {})


def counter(vocabulary: dict, remember: int = 1_000_000, kept: dict | None = None) -> Callable[[str], int]:
    """A function from a text to its number of tokens.

    Counts of short pieces met lately are remembered: ``remember`` of them at most, in ``kept`` if given.
    """
    import regex

    split, ranks, merged = regex.compile(SPLIT).findall, vocabulary["ranks"], vocabulary["merged"]
    added = vocabulary["added"]
    special = regex.compile("|".join(regex.escape(t) for t in sorted(added, key=len, reverse=True))) if added else None

    class Pieces(dict):
        def __missing__(self, piece: str) -> int:
            count = count_piece(piece.encode("utf-8"), ranks, merged)
            if len(piece) <= 64:
                if len(self) >= remember:
                    self.clear()
                self[piece] = count
            return count

    of = kept.setdefault("pieces", Pieces()).__getitem__ if kept is not None else Pieces().__getitem__

    def count(text: str) -> int:
        if special is None or not special.search(text):
            return sum(map(of, split(text)))
        parts = special.split(text)
        return len(parts) - 1 + sum(sum(map(of, split(part))) for part in parts if part)

    return count


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) of every row of ``docs``, as the byte-level BPE file at ``path`` splits it.

    The text is cut at added tokens (one token each), then by the public pattern; each piece starts as its bytes and
    loses one symbol per merge, so the count is symbols minus merges and no identifier is ever made. One pass over the
    scan, no shuffle. The driver reads the vocabulary file and broadcasts it: its size is fixed by the file.

    Null and empty texts count 0. Rows are independent: repeated rows and repeated ids give a row each, a null id stays
    null, other columns are not read. An empty table gives an empty table. A text is processed whole; a piece of n bytes
    takes O(n log n).
    """
    vocabulary = docs.sparkSession.sparkContext.broadcast(read_vocabulary(path))
    vocabulary_key = hashlib.sha256(repr(vocabulary.value["merged"]).encode() + repr(vocabulary.value["ranks"]).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(vocabulary.value, kept=worker_memory(f"pieces_{vocabulary_key}"))
        for batch in sliced(batches):
            texts = batch.column(1).to_pylist()
            sizes = [len(t.encode("utf-8")) if t else 0 for t in texts]
            tokens = [count(t) if t else 0 for t in texts]
            yield batch_of(
                doc_id=batch.column(0), n_bytes=pa.array(sizes, pa.int64()), n_tokens=pa.array(tokens, pa.int64()),
                over_limit=pa.array([n > limit for n in tokens], pa.bool_()),
            )

    id_type = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, f"doc_id {id_type}, n_bytes long, n_tokens long, over_limit boolean")
