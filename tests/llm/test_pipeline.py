import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

from concord.llm.pii import find

WORDS = "alpha bravo charlie delta echo foxtrot golf hotel india juliet kilo lima mike november oscar papa".split()


def text(seed, n=40):
    draw = random.Random(seed)
    return " ".join(draw.choice(WORDS) for _ in range(n)) + "."


@pytest.fixture
def folder(spark, tmp_path):
    passage = " ".join(f"question{i}" for i in range(14))
    rows = [(i, text(i) if i % 4 else " ".join(w + "%%%" for w in text(i).split()), "en", f"src{i % 3}") for i in range(120)]
    rows += [(200, text(1), "en", "src0"), (201, text(2) + " tail", "en", "src1"), (202, text(202) + "\n" + passage + " end", "en", "src0"), (203, text(203) + " mail ann.b@mail1.example.com now", "en", "src2")]
    rows += [(300, None, None, None), (301, "", "en", "src0")]
    docs = spark.createDataFrame([(*r, None if r[1] is None else len(r[1])) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, int(i % 4 != 0), 0) for i in range(120)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_stages_take_effect_one_after_another(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        out.write.parquet(f"{folder}/{len(seen)}.parquet")
        docs = spark.read.parquet(f"{folder}/{len(seen)}.parquet")
        seen.append({r.doc_id: r for r in docs.collect()})
        if len(seen) < len(corpus_pipeline.STAGES):
            assert docs.columns == columns, name
    good, first, clean, private, mixed = seen
    assert {i for i in range(120) if i % 4} <= set(good) and not any(i in good for i in range(0, 120, 4))
    assert set(good) - set(first) == {200, 201} and {1, 2} <= set(first)
    assert set(clean) == set(first) and "question" not in clean[202].text and clean[202].text.endswith("end") and clean[202].n_chars == len(clean[202].text)
    assert all(clean[i].text == good[i].text for i in clean if i != 202)
    assert "ann.b@mail1" not in private[203].text and [k for *_, k, _ in find(private[203].text)] == ["email"]
    assert all(private[i].text == clean[i].text for i in private if i != 203)
    assert set(mixed) <= set(private) and all(r.taken > 0 for r in mixed.values())
    shares = docs.groupBy("source").agg(F.first("target").alias("target"), F.sum("taken").alias("taken")).collect()
    assert all(abs(r.taken - r.target) <= 1 for r in shares)


def test_run_is_all_stages(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert rows and all(r.doc_id % 4 or r.doc_id >= 200 for r in rows) and not {200, 201} & {r.doc_id for r in rows}
    assert [n for n, _ in corpus_pipeline.STAGES][0] == "quality classifier" and len(corpus_pipeline.STAGES) == 5


def test_empty_tables(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []
