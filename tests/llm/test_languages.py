import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from concord.llm import languages
from concord.llm.languages import Languages, automaton, has_letter, predicted, samples, symbols
from concord.llm.queries import QUERIES, held_out_language

FOLDER = "/root/testdata/sf0.01"


def plain_phrases(text: bytes, sample: bytes) -> int:
    """Greedy longest matches by searching the sample."""
    n = 0
    for a in range(0, len(text), languages.STRETCH):
        part = text[a : a + languages.STRETCH]
        at = 0
        while at < len(part):
            size = 1
            while at + size < len(part) and part[at : at + size + 1] in sample:
                size += 1
            at += size
            n += 1
    return n


def test_symbols():
    assert symbols("Ab, C1d!\nÉ—") == " ab c d é— ".encode()
    assert symbols(None) == symbols("") == symbols("12 ..\t") == b""
    assert has_letter("漢", symbols("漢")) and has_letter("a1", symbols("a1")) and has_letter("«é»", symbols("«é»"))
    assert not has_letter("— «»", symbols("— «»")) and not has_letter(None, b"")


def test_an_automaton_knows_all_its_substrings_and_no_others():
    draw = random.Random(3)
    for _ in range(20):
        sample = bytes(draw.randrange(3) for _ in range(draw.randrange(1, 40)))
        step = automaton(sample, 3)
        assert len(step) <= 2 * len(sample)
        for _ in range(200):
            text, state = bytes(draw.randrange(3) for _ in range(draw.randrange(1, 8))), 0
            for code in text:
                state = step[state, code] if state >= 0 and step[state, code] else -1
            assert (state > 0) == (text in sample)


def test_phrases_are_greedy_longest_matches(monkeypatch):
    monkeypatch.setattr(languages, "STRETCH", 50)
    monkeypatch.setattr(languages, "LANES", 4)
    draw = random.Random(7)
    learnt = {name: bytes(draw.choice(b"abcde " if name == "x" else b"cdefg ") for _ in range(300)) for name in "xy"}
    texts = [b"", b"z", b"zazz"] + [bytes(draw.choice(b"abcdefgz ") for _ in range(draw.randrange(400))) for _ in range(30)]
    got = Languages.of(learnt).phrases(texts)
    assert got.tolist() == [[plain_phrases(t, s) for s in learnt.values()] for t in texts]


def brute(model, text):
    """(language, score) by plain parsing of one text."""
    parsed = symbols(text)
    if not text or not any(c.isalpha() for c in text) or not model:
        return "und", 0.0
    bits = {name: plain_phrases(parsed, s) * math.log2(len(s) + 1) for name, s in model.items()}
    least = min(bits.values())
    return min(n for n, b in bits.items() if b == least), 1 / sum(2.0 ** (least - b) for b in bits.values())


def labelled_docs(spark):
    rows = []
    draw = random.Random(11)
    words = {"aa": "the of and house river mountain".split(), "bb": "der und das haus berg fluss".split(), "cc": "le et la maison fleuve montagne".split()}
    for i in range(120):
        lang = "aabbcc"[2 * (i % 3) : 2 * (i % 3) + 2]
        rows.append((i, " ".join(draw.choice(words[lang]) for _ in range(draw.randrange(1, 30))), None if i % 17 == 5 else lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


@pytest.mark.parametrize("at_once", [1, 2, 8])
def test_same_languages_and_scores_as_brute_force(spark, at_once):
    docs = labelled_docs(spark)
    held = held_out_language()
    found = {r.doc_id: r for r in predicted(docs, held, languages=at_once, sample=400).collect()}
    rows = languages._labelled(docs, ~held, "doc_id", "text", "lang")
    model = samples(rows, rows.groupBy("language").agg(F.count("*").alias("n")).collect(), 400)
    assert list(model) == ["aa", "bb", "cc"] and all(len(s) < 400 + 3 * languages.PLACE for s in model.values())
    for doc_id, text, _ in docs.collect():
        lang, score = brute(model, text)
        assert found[doc_id].lang_pred == lang and np.isclose(found[doc_id].score, score)
        assert found[doc_id].held_out == (zlib.crc32(str(doc_id).encode()) % 4 == 2)


def test_held_out_labels_are_not_read(spark):
    docs = labelled_docs(spark)
    held = held_out_language()
    wrong = docs.withColumn("lang", F.when(held, F.lit("zz")).otherwise(F.col("lang")))
    got = lambda d: sorted(predicted(d, held).collect())
    assert got(docs) == got(wrong)


def test_hard_rows(spark, docs, hard):
    found = predicted(docs(hard), held_out_language()).collect()
    assert len(found) == len(hard) and {r.lang_pred for r in found} == {"en", "und"}
    assert all(r.lang_pred == "und" and r.score == 0 for r in found if r.doc_id in (1, 2, 3))
    assert all(r.lang_pred == "en" and r.score == 1 for r in found if r.doc_id not in (1, 2, 3))
    assert predicted(docs([]), held_out_language()).collect() == []
    none = docs(hard).withColumn("lang", F.lit(None).cast("string"))
    assert {(r.lang_pred, r.score) for r in predicted(none, held_out_language()).collect()} == {("und", 0.0)}


def test_a_hot_id_and_text_is_learnt_once(spark):
    docs = spark.createDataFrame([(1, "same words again and again", "en")] * 500 + [(3, "other words", "en"), (4, "andere worte", "de")], "doc_id long, text string, lang string")
    rows = languages._labelled(docs, F.lit(True), "doc_id", "text", "lang")
    model = samples(rows, rows.groupBy("language").agg(F.count("*").alias("n")).collect())
    assert model["de"] == b" andere worte " and len(model["en"]) == len(symbols("same words again and again") + symbols("other words"))


def test_held_out_accuracy(spark):
    found = QUERIES["op11_languages"](spark, FOLDER)
    assert found.columns == ["doc_id", "held_out", "lang_pred", "score"]
    true = spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang", "text")
    rows = found.join(true, "doc_id").where("held_out AND lang_pred <> 'und'").collect()
    assert len(rows) > 200 and sum(r.lang == r.lang_pred for r in rows) / len(rows) > 0.97
    assert all(0 <= r.score <= 1 for r in rows)
