"""Pseudo-likelihood on held-out text, and the pipeline's stages."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from quire.llm import pseudo_likelihood as P


def sentence(rng):
    return " ".join(f"{a} {b} {c}" for a, b, c in [rng.choice([("the", "old", "cat"), ("a", "red", "fox"), ("my", "own", "dog")]) for _ in range(20)])


def corpus(rng):
    return [(i, sentence(rng), 3) for i in range(1500)] + [(None, None, None), (5000, "", 1), (5001, "the " * 40000, 1), (7, "same id", 1), (7, "same id", 2), (5002, "new", 1)]


def test_network_orders_held_out_text(spark):
    rng = random.Random(1)
    docs = spark.createDataFrame(corpus(rng), "doc_id long, text string, n_tokens int").repartition(4)
    model = P.train(docs, rounds=3)
    held = [sentence(rng) for _ in range(60)]
    mixed = [" ".join(rng.sample(t.split(), 60)) for t in held]

    def mean(texts):
        logs, _, offsets = P.token_scores(model, pa.array(texts))
        return np.array([x.mean() for x in np.split(logs, offsets[1:-1])])

    assert (mean(held) > mean(mixed)).mean() > 0.95
    assert P.score(docs.limit(0), P.train(docs.limit(0))).count() == 0


def brute_scores(rows, model):
    """(id, tokens, sum) from all texts by dictionaries over neighbours and words."""
    contexts, there = {}, []
    for i, text, _ in rows:
        words = (text or "").split()
        logs = P.token_scores(model, pa.array([text or ""]))[0]
        keys = [((words[k - 1] if k else None), (words[k + 1] if k + 1 < len(words) else None)) for k in range(len(words))]
        for key, w in zip(keys, words):
            contexts.setdefault(key, Counter())[w] += 1
        there.append((i, words, keys, np.round(-logs / P.LOG_STEP) * -P.LOG_STEP))
    out = []
    for i, words, keys, logs in there:
        total = 0.0
        for w, key, log in zip(words, keys, logs):
            total += np.log((contexts[key][w] - 1 + P.PRIOR * np.exp(log)) / (sum(contexts[key].values()) - 1 + P.PRIOR))
        out.append((str(i), len(words), total))
    return sorted(out)


@pytest.mark.parametrize("bits", [12, 2])
def test_scores_equal_brute_force(spark, bits, monkeypatch):
    rng = random.Random(1)
    rows = corpus(rng)
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    model = P.train(docs.repartition(3))
    monkeypatch.setattr(P, "EXCHANGE_BITS", bits)
    monkeypatch.setattr(P, "CHUNK_TOKENS", 20_000)  # several buckets, for few bits several exchanges
    got = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in P.score(docs.repartition(5), model).collect())
    want = brute_scores(rows, model)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 1e-6 * (1 + w[1]) for g, w in zip(got, want))  # every token is rounded to millionths
    means = {str(r.doc_id): r["mean"] for r in P.score(docs, model).collect()}
    assert means["None"] is None and means["5000"] is None


@pytest.mark.parametrize("bits", [12, 2])
def test_scores_do_not_depend_on_parts(spark, bits, monkeypatch):
    """Frequent contexts are dealt into many parts, and scored by all their tokens."""
    rng = random.Random(1)
    rows = [*corpus(rng), *[(7000 + i, " ".join(rng.choices(["the", "of", "and", "one"], [8, 4, 2, 1], k=40)), 0) for i in range(100)]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    with monkeypatch.context() as m:
        m.setattr(P, "CHUNK_TOKENS", 100)
        model = P.train(docs.repartition(3))
    assert (model.parts > 3).sum() >= 3
    monkeypatch.setattr(P, "EXCHANGE_BITS", bits)
    monkeypatch.setattr(P, "CHUNK_TOKENS", 5_000)
    got = sorted((str(r.doc_id), r.n_tokens, r.log_likelihood) for r in P.score(docs.repartition(5), model).collect())
    want = brute_scores(rows, model)
    assert [g[:2] for g in got] == [w[:2] for w in want]
    assert all(abs(g[2] - w[2]) <= 1e-6 * (1 + w[1]) for g, w in zip(got, want))


def test_layout_does_not_matter(spark, monkeypatch):
    monkeypatch.setattr(P, "SHARD_BYTES", 20_000)  # a tree of several levels
    monkeypatch.setattr(P, "FAN_IN", 3)
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    layouts = [docs.coalesce(1), docs.repartition(7), docs.repartition(2, "source")]
    one, *others = (sorted((r.doc_id, r.n_tokens, r.log_likelihood) for r in P.score(d, P.train(d)).collect()) for d in layouts)
    assert all(one == other for other in others)


def test_texts_that_occur_twice_stand_apart(spark):
    """Texts of words in random order: those that another document repeats are far likelier than those that occur once."""
    rng = random.Random(9)
    vocab = [f"{a}{b}{c}" for a in "ba de fi go ku".split() for b in "ro sa ti vu wen".split() for c in range(80)]
    once = [(i, " ".join(rng.choices(vocab, k=80)), 0) for i in range(400)]
    rows = once + [(1000 + i, once[i][1], 0) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    got = {r.doc_id: r["mean"] for r in P.score(docs, P.train(docs)).collect()}
    assert min(got[i] for i in range(40)) > max(got[i] for i in range(40, 400)) + 1


def test_frequent_contexts_are_dealt_into_parts(monkeypatch):
    monkeypatch.setattr(P, "CHUNK_TOKENS", 100)
    words = P.W.Words(*P.W.text_buffer(pa.array(["a x b"] * 1000 + ["rare y b"])))
    hashes = words.hashes()
    model = P.Model(None, None, None, np.append(np.maximum(1, -(-np.bincount((hashes >> np.uint64(44)).astype(np.int64), minlength=1 << 20) // 100)), 31), 20)
    rows = np.repeat(np.random.default_rng(1).integers(-(2**62), 2**62, 1001), 3)
    contexts = P.context_hashes(model, hashes, words.offsets, rows)
    assert 8 <= len(set(contexts[1:3000:3].tolist())) <= 10 and np.bincount(np.unique(contexts[1:3000:3], return_inverse=True)[1]).max() < 150


def test_gradient_is_the_derivative():
    rng = np.random.default_rng(2)
    net = P.Network.start(np.full(P.CLASSES * P.GROUPS, 1 / P.CLASSES / P.GROUPS))
    net.inner, net.outer, net.finer = (x.astype(np.float64) for x in net.parts())
    context, target = rng.integers(0, P.CLASSES + 1, (2 * P.SIDE, 50)), rng.integers(0, P.CLASSES * P.GROUPS, 50)
    loss = lambda: -net.log_probability(context, target).mean()
    for weights, grad in zip(net.parts(), net.gradient(context, target)):
        at = tuple(int(x[7]) for x in np.nonzero(np.abs(grad) > 1e-4))
        weights[at] += 1e-5
        up = loss()
        weights[at] -= 2e-5
        assert abs((up - loss()) / 2e-5 - grad[at]) < 1e-6
        weights[at] += 1e-5


def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.01"  # the smallest tables have too few toxic labels for any evidence
    docs = spark.read.parquet(f"{d}/documents.parquet")
    columns, sizes = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, d), name)
        assert docs.columns == columns
        sizes.append(docs.count())
    assert sizes[0] > sizes[1] > sizes[2] > sizes[3] > 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, d).count() == sizes[4]
