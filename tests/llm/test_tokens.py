import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from concord.llm.tokens import byte_symbols, count_piece, counter, read_vocabulary, token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def vocabulary():
    return read_vocabulary(PATH)


def test_same_counts_as_the_library(library, vocabulary):
    count, draw = counter(vocabulary, remember=50), random.Random(1)
    pool = "ab  \t\n\r\x0b\x0c\x1c\x85　​ 'sStrelvd0129½Ⅷ²_-.,!?@#éßñ中文字日本́🙂👍🏽﻿"
    for _ in range(1500):
        text = "".join(draw.choice(pool) for _ in range(draw.randrange(40)))
        text = text if draw.random() < 0.7 else text[:7] + "<|endoftext|>" + text[7:]
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids), repr(text)


def test_long_pieces(library, vocabulary):
    count = counter(vocabulary)
    for text in ("x" * 5_000, "ab" * 3_000, " " * 4_000, "ñ" * 2_000, "1234567890" * 300):
        assert count(text) == len(library.encode(text, add_special_tokens=False).ids)


def test_leftmost_of_equal_ranks_goes_first():
    # aaa with one merge: the left pair joins, the right a stays
    assert count_piece(b"aaa", {(97, 97): 0}, [256]) == 2
    assert count_piece(b"aaaa", {(97, 97): 0, (256, 256): 1}, [256, 257]) == 1
    assert count_piece(b"", {}, []) == 0


def test_byte_symbols_are_distinct():
    assert len(set(byte_symbols())) == 256 and byte_symbols()[32] == "Ġ"


def test_hard_rows(docs, hard, library):
    rows = token_counts(docs(hard), PATH, limit=100).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 100) for i, t in hard]
    assert sorted(map(tuple, rows), key=str) == sorted(want, key=str)
    assert token_counts(docs([]), PATH).collect() == []
