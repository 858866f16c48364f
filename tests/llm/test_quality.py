import random
import zlib

import numpy as np
import pytest

from concord.llm.common import WordHash
from concord.llm.quality import STATS, WORD_BITS, Machine, Rows, features, fit_machine, quality_scores


def corpus(n=400, seed=2):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(draw.choice("abcdefghijk") for _ in range(draw.randint(2, 8))) for _ in range(draw.randint(20, 80))]
        good = i % 3 != 0
        if not good:
            words = [w + draw.choice(["%%%", "$$$", " |"]) for w in words]
        rows.append((i, " ".join(words) + "."))
        labels.append((i, int(good), 0))
    return rows, labels


def label_table(spark, labels):
    return spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_held_out_accuracy(spark, docs):
    rows, labels = corpus()
    truth = {i: q for i, q, _ in labels}
    found = quality_scores(docs(rows), label_table(spark, labels)).collect()
    assert len(found) == len(rows) and all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    held = [r for r in found if r.held_out]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found)


def test_scores_rest_on_text_and_length_alone(spark, docs):
    rows, labels = corpus(120)
    df, marks = docs(rows), label_table(spark, labels)
    first = {r.doc_id: r.score for r in quality_scores(df, marks).collect()}
    flipped = [(i, 1 - q if zlib.crc32(str(i).encode()) % 5 == 0 else q, 1 - t) for i, q, t in labels]  # held-out labels don't matter
    from pyspark.sql import functions as F

    changed = df.withColumn("lang", F.lit("xx")).withColumn("source", F.lit(None).cast("string")).repartition(3)
    assert {r.doc_id: r.score for r in quality_scores(changed, label_table(spark, flipped)).collect()} == pytest.approx(first, abs=1e-6)


def test_pairs_in_linear_time_are_all_pairs():
    draw = np.random.default_rng(1)
    machine = Machine(rank=3)
    machine.linear[:] = draw.standard_normal(len(machine.linear))
    machine.pairs[:] = draw.standard_normal(machine.pairs.shape)
    machine.bias = 0.4
    rows = Rows(np.array([0, 3, 3, 5]), np.array([4, 9, 77, 4, 5000], np.int32), draw.random(5).astype(np.float32), draw.random((3, len(STATS))).astype(np.float32))
    raw = machine.raw(rows)[0]
    for i in range(3):
        x = np.zeros(len(machine.linear))
        x[rows.index[rows.start[i] : rows.start[i + 1]]] = rows.value[rows.start[i] : rows.start[i + 1]]
        x[1 << WORD_BITS :] = machine.scaled(rows.stats)[i]
        on = np.flatnonzero(x)
        pairs = sum(float(machine.pairs[a] @ machine.pairs[b]) * x[a] * x[b] for n, a in enumerate(on) for b in on[n + 1 :])
        assert raw[i] == pytest.approx(0.4 + machine.linear[on] @ x[on] + pairs, rel=1e-3, abs=1e-3)


def test_slices_do_not_change_features(monkeypatch):
    from concord.llm import quality

    texts = [b"a b c a", b"", None, b"d " * 50, "é".encode() * 9]
    whole = [p for _, p in features(texts, [None] * 5, WordHash())]
    monkeypatch.setattr(quality, "SLICE_WORDS", 3)
    parts = [p for _, p in features(texts, [None] * 5, WordHash())]
    assert len(whole) == 1 < len(parts)
    assert np.array_equal(whole[0].stats, np.concatenate([p.stats for p in parts])) and np.array_equal(whole[0].index, np.concatenate([p.index for p in parts]))


def test_hard_rows_and_bounds(spark, docs, hard):
    labels = label_table(spark, [(4, 1, 0), (5, 0, 0), (6, None, 0), (None, 1, 0), (7, 2, 0), (4, 1, 1), (8, 1, 0)])
    for marks in (labels, label_table(spark, [])):
        rows = quality_scores(docs(hard), marks).collect()
        assert len(rows) == len(hard) and all(np.isfinite(r.score) for r in rows)
    assert quality_scores(docs([]), labels).collect() == []
    kept = quality_scores(docs(hard), labels, keep=True)
    assert kept.columns == [c for c in docs(hard).columns if c != "score"] + ["held_out", "score", "predicted"] and kept.count() == len(hard)
    rows, marks = corpus(60)
    small = fit_machine(docs(rows), label_table(spark, marks), most=5)
    assert np.count_nonzero(small.linear[: 1 << WORD_BITS]) <= 5 * 80


def test_an_id_on_many_rows_leaves_the_other_labels(spark, docs, monkeypatch):
    ids = [i for i in range(30) if zlib.crc32(str(i).encode()) % 5][:6]
    rows = [(ids[0], f"text {i}") for i in range(60)] + [(i, f"other {i}") for i in ids[1:]]
    held = []
    monkeypatch.setattr(Machine, "fit", lambda self, rows, labels: held.append(labels.tolist()) or self)
    fit_machine(docs(rows), label_table(spark, [(i, int(i != ids[0]), 0) for i in ids]), most=6)
    assert sorted(held[0]) == [0, 1, 1, 1, 1, 1]
