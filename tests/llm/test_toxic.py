"""The field against enumeration, its gradient, and held-out labels."""

import itertools

import numpy as np
import pytest

from framelake.llm import common, toxic_spans
from framelake.llm.toxic_spans import BREAK, Chains, Field

DOCS = "doc_id BIGINT, text STRING, score DOUBLE, spans STRING"


def brute_marginals(emission, moves):
    """Toxic probabilities of one chain, over all state sequences."""
    total, mine = 0.0, np.zeros(len(emission))
    for states in itertools.product((0, 1), repeat=len(emission)):
        weight = np.exp(sum(e * s for e, s in zip(emission, states, strict=True)) + sum(moves[a, b] for a, b in itertools.pairwise(states)))
        total += weight
        mine += weight * np.array(states)
    return mine / total


def test_marginals_equal_enumeration():
    rng = np.random.default_rng(3)
    model = Field(moves=rng.normal(0, 1, (2, 2)))
    lengths = [3, 1, 7, 2, 2, 5]
    ids = np.concatenate([[BREAK], *[[0] * n + [BREAK] for n in lengths], [BREAK]]).astype(int)
    emission = rng.normal(0, 2, sum(lengths))
    got = model.marginals(emission, Chains.of(ids))
    want = np.concatenate([brute_marginals(e, model.moves) for e in np.split(emission, np.cumsum(lengths)[:-1])])
    assert np.allclose(got, want)


def test_long_runs_go_on_in_new_chains(monkeypatch):
    monkeypatch.setattr(toxic_spans, "CHAIN", 4)
    rng = np.random.default_rng(4)
    model, emission = Field(moves=rng.normal(0, 1, (2, 2))), rng.normal(0, 2, 10)
    got = model.marginals(emission, Chains.of(np.zeros(10, int)))
    assert np.allclose(got, np.concatenate([brute_marginals(e, model.moves) for e in np.split(emission, [4, 8])]))


def test_gradient_equals_differences():
    rng = np.random.default_rng(5)
    moves, ids = rng.normal(0, 1, (2, 2)), np.array([0, 0, 0, 0, BREAK, 0, 0, BREAK])
    emission, truth = rng.normal(0, 1, 6), np.array([0, 1, 1, 0, 0, 1])

    def likelihood(e, m):
        out = 0.0
        for part, states in zip(np.split(e, [4]), np.split(truth, [4]), strict=True):
            weigh = lambda s: sum(x * k for x, k in zip(part, s, strict=True)) + sum(m[a, b] for a, b in itertools.pairwise(s))
            out += weigh(states) - np.log(sum(np.exp(weigh(s)) for s in itertools.product((0, 1), repeat=len(part))))
        return out

    by_token, by_move = Field(moves=moves).gradient(emission, Chains.of(ids), truth)
    for k in range(6):
        step = np.eye(6)[k] * 1e-6
        assert abs((likelihood(emission + step, moves) - likelihood(emission - step, moves)) / 2e-6 - by_token[k]) < 1e-6
    for k in range(4):
        step = np.eye(4)[k].reshape(2, 2) * 1e-6
        assert abs((likelihood(emission, moves + step) - likelihood(emission, moves - step)) / 2e-6 - by_move.ravel()[k]) < 1e-6


def made_up(n, seed=0):
    """Texts of random words; every third holds one of two bad words, or a word with a bad beginning."""
    rng = np.random.default_rng(seed)
    words = ["".join(rng.choice(list("abcdefghiklmnoprstuw"), rng.integers(3, 8))) for _ in range(400)]
    texts, labels, places = [], [], []
    for k in range(n):
        row = list(rng.choice(words, rng.integers(6, 60)))
        bad = k % 3 == 0
        if bad:
            at = int(rng.integers(0, len(row)))
            row[at] = ["vilest", "wretch", "grumble" + words[k % 400][:2]][k % 9 // 3]
            places.append(row[at])
        texts.append(" ".join(row) + ".")
        labels.append(int(bad))
    return texts, labels, places


def test_spans_and_scores_of_new_texts(spark):
    texts, labels, _ = made_up(600)
    model = toxic_spans.fit(texts, labels)
    new, truth, bad = made_up(90, seed=0)
    docs = spark.createDataFrame([(k, f"Ünd. {t}", 0.5, "clash") for k, t in enumerate(new)], DOCS)
    got = {r["doc_id"]: r for r in toxic_spans.score(docs, model).collect()}
    assert [got[k]["predicted"] for k in range(90)] == truth
    tagged = [f"Ünd. {new[k]}"[s["start"] : s["stop"]] for k in range(90) if truth[k] for s in got[k]["spans"]]
    assert tagged == bad
    left = toxic_spans.drop_toxic(docs, model)
    assert left.columns == docs.columns and {r["doc_id"] for r in left.collect()} == {k for k in range(90) if not truth[k]}


def test_nulls_empty_long_and_repeated_texts(spark):
    texts, labels, _ = made_up(300)
    model = toxic_spans.fit(texts, labels)
    long = "calm words here " * 60_000 + "vilest"
    docs = spark.createDataFrame([(1, None), (2, ""), (3, ".!?"), (4, long), (None, "vilest"), (6, "vilest"), (6, "vilest")], "doc_id BIGINT, text STRING")
    got = [r.asDict() for r in toxic_spans.score(docs, model).collect()]
    empty = [r for r in got if r["doc_id"] in (1, 2, 3)]
    assert len({r["score"] for r in empty}) == 1 and all(r["n_tokens"] == 0 and r["spans"] == [] and r["predicted"] == 0 for r in empty)
    one = next(r for r in got if r["doc_id"] == 4)
    assert one["n_tokens"] == 180_001 and [(s["start"], s["stop"]) for s in one["spans"]] == [(len(long) - 6, len(long))]
    assert next(r for r in got if r["doc_id"] is None)["held_out"] is True
    assert len({r["score"] for r in got if r["doc_id"] == 6}) == 1
    assert toxic_spans.score(docs.limit(0), model).count() == 0


def test_without_two_classes(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, "c")], "doc_id BIGINT, text STRING")
    for labels, want in (([(1, 1), (3, 1)], 1.0), ([(1, 0)], 0.0), ([], 0.0), ([(1, 0), (1, 1)], 0.0), ([(None, 1), (1, None)], 0.0)):
        model = toxic_spans.train(docs, spark.createDataFrame(labels, "doc_id BIGINT, toxic INT"))
        assert [r["score"] for r in toxic_spans.score(docs, model).collect()] == [want, want]


def test_copies_count_once():
    assert toxic_spans.distinct_texts(["a b c d e f", "a b c d e f", "a b c d e g", "x y", "x y", ""], 0.5) == [0, 3, 5]


def test_training_keeps_to_its_bounds(spark):
    texts, labels, _ = made_up(200)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id BIGINT, text STRING")
    known = spark.createDataFrame(list(enumerate(labels)), "doc_id BIGINT, toxic INT")
    read = []
    real = toxic_spans.fit
    law = toxic_spans.Training(rows=20, toxic_bytes=8_000, clean_bytes=3_000)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(toxic_spans, "fit", lambda t, y, law: read.append((t, y)) or real(t, y, law))
        toxic_spans.train(docs, known, law)
    t, y = read[0]
    assert sum(len(a) for a, b in zip(t, y, strict=True) if b == 0) <= 3_000 and sum(y) <= 20


def test_held_out_labels(spark, sf_small="/root/testdata/sf0.1"):
    docs, labels = common.table(spark, sf_small, "documents"), common.table(spark, sf_small, "labels")
    got = toxic_spans.score(docs, toxic_spans.train(docs, labels)).join(labels, "doc_id").where("held_out").select("predicted", "toxic").toPandas()
    assert ((got["predicted"] == 1) & (got["toxic"] == 0)).sum() < 0.01 * (got["toxic"] == 0).sum()
    assert ((got["predicted"] == 1) & (got["toxic"] == 1)).sum() > 0.8 * (got["toxic"] == 1).sum()
