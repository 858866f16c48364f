import numpy as np
import pytest

from concord.llm import scoring
from concord.llm.scoring import SIDE, TOKENS, Network, Numbering, averaged, common_words, padded, scores, trained


def net_of(width=4, seed=2):
    draw = np.random.default_rng(seed)
    net = Network.start(width, draw.integers(0, 50, TOKENS).astype(float))
    net.flat += draw.standard_normal(net.flat.shape).astype(np.float32) * 0.3
    return net


def plain(net, tokens, i):
    """The distribution of the token at ``i`` over all tokens, one step at a time."""
    context, bias, top, top_bias, members, member_bias = (x.astype(np.float64) for x in net.parts())
    around = [tokens[j] if 0 <= (j := i + o) < len(tokens) else TOKENS for o in (-2, -1, 1, 2)]
    h = np.tanh(bias + sum(context[n, t] for n, t in enumerate(around)))
    soft = lambda x: np.exp(x - x.max()) / np.exp(x - x.max()).sum()
    group = soft(top @ h + top_bias)
    return np.concatenate([group[g] * soft(members[g] @ h + member_bias[g]) for g in range(SIDE)])


def test_predictions_are_the_masked_conditionals():
    net, draw = net_of(), np.random.default_rng(1)
    texts = [draw.integers(0, TOKENS, n) for n in (7, 0, 1, 30)]
    flat, at = padded(texts)
    got, i = net.predict(flat, at), 0
    for t in texts:
        for j in range(len(t)):
            share = plain(net, t, j)
            assert share.sum() == pytest.approx(1)
            assert got[i] == pytest.approx(np.log(share[t[j]]), abs=1e-4)
            i += 1
    assert i == len(got)


def test_gradient():
    net = net_of()
    net.flat = net.flat.astype(np.float64)
    flat, at = padded([np.array([3, 900, 17, 3, 3, 2000, 65])])
    held = []
    net.predict(flat, at, held.append)
    loss = lambda: -net.predict(flat, at).mean()
    used = np.argsort(-np.abs(held[0]))[:40]
    for k in used[::4]:
        before = net.flat[k]
        net.flat[k] = before + 1e-3
        up = loss()
        net.flat[k] = before - 1e-3
        down = loss()
        net.flat[k] = before
        assert held[0][k] == pytest.approx((up - down) / 2e-3, rel=0.05, abs=1e-5)


def corpus(docs):
    line = "the cat sat on the mat and the dog lay by the door"
    return docs([(i, line if i % 2 else line.upper()) for i in range(60)] + [(100 + i, f"rare{i} words{i}") for i in range(5)]).repartition(3)


def test_counts_are_of_all_texts(docs):
    common, counts = common_words(corpus(docs))
    assert list(common)[0] == b"the" and counts[0] == 240 and counts.sum() == 60 * 13 + 10
    few, counts = common_words(corpus(docs), most=2)
    assert len(few) == 2 and counts.sum() == 790 and counts[scoring.COMMON :].sum() == 790 - counts[:2].sum()


def test_training_learns_and_repeats(docs):
    df = corpus(docs).select("doc_id", "text")
    common, net = trained(df, width=8, rate=0.5)
    start = Network.start(8, common_words(df)[1])
    flat, at = padded([Numbering(common).of(b"The cat sat on the mat and the dog lay by the door")])
    assert net.predict(flat, at).mean() > start.predict(flat, at).mean() + 0.2
    again = trained(df, width=8, rate=0.5)[1]
    assert np.array_equal(net.flat, again.flat)


def test_means_by_weight_over_many_tasks(spark):
    rows = [(b, p, float(p + 1), np.full(3, p, np.float32).tobytes()) for b in range(2) for p in range(150)]
    flat = averaged(spark.createDataFrame(rows, "block long, part long, weight double, values binary"))
    want = sum(p * (p + 1) for p in range(150)) / sum(p + 1 for p in range(150))
    assert flat.shape == (6,) and np.allclose(flat, want)


def test_scores_are_sums_over_whole_texts(docs, hard, monkeypatch):
    rows = scores(docs(hard)).collect()
    assert len(rows) == len(hard)
    by = {r.doc_id: r for r in rows}
    assert (by[1].n_tokens, by[1].log_likelihood, by[1].per_token) == (0, 0.0, None) and by[2].n_tokens == by[3].n_tokens == 0
    assert by[4].n_tokens == 30_000 and by[4].log_likelihood == pytest.approx(by[7].log_likelihood) and by[4].log_likelihood < 0
    assert by[4].per_token == pytest.approx(by[4].log_likelihood / 30_000)
    assert scores(docs([])).collect() == []


def test_rare_words_have_their_exact_shares(docs):
    """Words of one hash class are told apart by their own counts, by broadcast or by a join."""
    common = {f"c{i}".encode(): i for i in range(scoring.COMMON)}
    number = Numbering(common)
    a, b = b"rare0", next(w for i in range(1, 10**6) if number[w := b"rare%d" % i] == number[b"rare0"])
    rows = [(i, " ".join(f"c{j}" for j in range(scoring.COMMON))) for i in range(9)]
    rows += [(100 + i, a.decode()) for i in range(7)] + [(200, b.decode())]
    made = {r.doc_id: r for r in scores(docs(rows)).collect()}
    assert made[100].log_likelihood - made[200].log_likelihood == pytest.approx(np.log(7))
    joined = {r.doc_id: r for r in scores(docs(rows), head=0).collect()}
    assert all(joined[i].log_likelihood == pytest.approx(made[i].log_likelihood) for i in made) and joined[0].n_tokens == scoring.COMMON


def test_vocabulary_and_side_grow_with_the_corpus(docs):
    df = docs([(i, " ".join(f"w{j}" for j in range(5_000))) for i in range(3)])
    common, counts = common_words(df, least=3)
    assert len(common) == 5_000 and len(counts) > TOKENS and counts[:5_000].sum() == counts.sum() == 15_000
    net = Network.start(4, counts)
    assert net.side**2 == len(counts) and len(common_words(df)[0]) == scoring.COMMON


def test_words_are_looked_up_once_a_part(hard, monkeypatch):
    """The reader's tokens are those of ``Numbering`` word by word, and only distinct words outside the head reach it."""
    import pyarrow as pa

    texts = [t for _, t in hard] + [None, "The THE the\x0bcat \x0c", "cat rare rare Rare\u00c9", " "]
    common = {b"the": 0, b"cat": 1}
    reader = scoring.Reader([b"the", b"cat", b"word3", b"one"], np.array([0, 1, *(Numbering(common)[w] for w in (b"word3", b"one"))]), common)
    asked = []
    monkeypatch.setattr(reader.numbering, "digest", lambda w, seed, f=reader.numbering.digest: (asked.append(w), f(w, seed))[1])
    sizes, tokens, place, outside, which, distinct = reader.read(pa.array(texts, pa.string()))
    said = [(t or "").encode().lower().split() for t in texts]
    assert sizes.tolist() == [len(x) for x in said]
    assert tokens.tolist() == [t for x in texts for t in Numbering(common).of((x or "").encode())]
    words = [w for x in said for w in x]
    assert [words[i] for i in outside] == distinct.take(pa.array(which)).to_pylist() and len(outside) == (place < 0).sum()
    assert len(asked) == len(set(asked)) == len(distinct) < len(outside)


def test_parts_hold_a_bounded_size_of_texts(monkeypatch):
    import pyarrow as pa

    monkeypatch.setattr(scoring, "READ", 10)
    batch = pa.RecordBatch.from_arrays([pa.array(["a" * 4, None, "b" * 5, "c" * 30, "", "d" * 9, "e" * 2])], ["text"])
    parts = [p.column(0).to_pylist() for p in scoring.parted(iter([batch]), 0)]
    assert parts == [["aaaa", None, "bbbbb"], ["c" * 30], ["", "d" * 9], ["ee"]]


def test_parts_hold_rows_of_several_batches(monkeypatch):
    import pyarrow as pa

    def parts(*batches):
        rows = [pa.RecordBatch.from_arrays([pa.array(b, pa.string())], ["text"]) for b in batches]
        return [p.column(0).to_pylist() for p in scoring.parted(iter(rows), 0)]

    monkeypatch.setattr(scoring, "READ", 10)
    assert parts(["aaaa"], [], ["bbb", None], ["ccc"], ["d", "e" * 12], [None, "f"]) == [["aaaa", "bbb", None, "ccc"], ["d"], ["e" * 12], [None, "f"]]
    monkeypatch.setattr(scoring, "PIECES", 2)
    assert parts([None], [None], [None], ["a"], [""]) == [[None, None], [None, "a"], [""]]
    assert parts() == []


def test_biases_stand_behind_their_weights():
    """Outputs are one product: h ends with a one, and no gradient comes back through it."""
    net, draw = net_of(), np.random.default_rng(4)
    flat, at = padded([draw.integers(0, TOKENS, 50)])
    assert (net.hidden(flat, at)[:, -1] == 1).all()
    top, members = net.stored()[2:]
    assert top.shape == (SIDE, 5) and members.shape == (SIDE, SIDE, 5) and sum(x.size for x in net.parts()) == len(net.flat)
    held = []
    net.predict(flat, at, held.append)
    gradient = net.parts(held[0])
    for weights, bias in ((gradient[2], gradient[3]), (gradient[4], gradient[5])):
        assert np.abs(bias.sum(-1)).max() < 1e-5 and np.abs(weights.sum(-2)).max() < 1e-5  # of a softmax, they sum to nothing


def test_rare_words_have_the_numbers_of_single_lookups():
    numbering = Numbering({b"the": 0})
    words = [b"rare%d" % i for i in range(500)] + ["\u6f22".encode(), b"\xff"]
    assert numbering.rare(words).tolist() == [numbering[w] for w in words] and numbering.rare([]).tolist() == []


def test_a_batch_learns_only_the_vectors_around_it():
    """The same as AdaGrad on all parameters, with gradients of the tokens that the batch reads."""
    net, plainly = net_of(), net_of()
    flat, at = padded([np.array([3, 900, 17, 3, 3, 2000, 65]), np.array([5])])
    learn, power = net.descent(0.1), np.full_like(plainly.flat, 1e-8)
    for part in (at[:5], at[5:], at):
        used, near, others = net.passed(flat, part, True)[1]
        assert set(used) == {t for i in part for o in scoring.REACH for t in [flat[i + o]]} and len(near) == len(used) < 10
        held = []
        plainly.predict(flat, part, held.append)
        power += held[0] ** 2
        plainly.flat -= np.float32(0.1) * held[0] / np.sqrt(power)
        learn(flat, part)
        assert np.allclose(net.flat, plainly.flat, rtol=1e-4, atol=1e-6)
