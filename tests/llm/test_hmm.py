"""Forward probabilities by enumeration, Baum-Welch by a plain recursion, and scores by a plain count."""

import itertools
import math
import random
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import hmm as H


def some_model(states=3, words=4, seed=1):
    rng = np.random.default_rng(seed)
    rows = lambda shape: (lambda m: m / m.sum(axis=-1, keepdims=True))(rng.uniform(0.1, 1, shape))
    names = {f"w{i}".encode(): i + 2 for i in range(words)}
    return H.Hmm(names, rows(states), rows((states, states)), rows((states, words + 2)))


def by_enumeration(model, sequence):
    total = 0.0
    for path in itertools.product(range(len(model.start)), repeat=len(sequence)):
        p = model.start[path[0]] * model.emit[path[0], sequence[0]]
        for a, b, token in zip(path, path[1:], sequence[1:]):
            p *= model.move[a, b] * model.emit[b, token]
        total += p
    return total


def packed(sequences):
    return H.Packed(np.concatenate([np.array(s, np.int32) for s in sequences]), np.array([len(s) for s in sequences]))


def test_scaled_forward_is_the_sum_over_all_paths():
    model, rng = some_model(), random.Random(2)
    sequences = [[rng.randrange(6) for _ in range(n)] for n in (1, 5, 3, 1, 6, 2)]
    found = packed(sequences).log_probabilities(model)
    assert np.allclose(found, [math.log10(by_enumeration(model, s)) for s in sequences])


def test_expected_counts_are_sums_over_paths():
    model, sequences = some_model(states=2), [[2, 3, 0], [4], [5, 5, 1, 0]]
    counts = {"start": np.zeros(2), "move": np.zeros((2, 2)), "emit": np.zeros((2, 6)), "gained": np.zeros(2)}
    packed(sequences).expected(model, counts)
    expected = {name: np.zeros_like(value) for name, value in counts.items()}
    for sequence in sequences:
        whole = by_enumeration(model, sequence)
        expected["gained"] += (math.log10(whole), len(sequence))
        for path in itertools.product(range(2), repeat=len(sequence)):
            p = model.start[path[0]] * model.emit[path[0], sequence[0]]
            for a, b, token in zip(path, path[1:], sequence[1:]):
                p *= model.move[a, b] * model.emit[b, token]
            expected["start"][path[0]] += p / whole
            for a, b in zip(path, path[1:]):
                expected["move"][a, b] += p / whole
            for state, token in zip(path, sequence):
                expected["emit"][state, token] += p / whole
    for name in counts:
        assert np.allclose(counts[name], expected[name], rtol=1e-4)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    kinds = [["der", "die", "und", "das"], ["the", "of", "and", "to"]]
    texts = [" ".join(rng.choice(kinds[i % 2] + [f"rare{rng.randrange(30)}"]) for _ in range(rng.randint(1, 40))) for i in range(120)]
    return [(i, text, "word", "score") for i, text in enumerate(texts + ["", None, "  \n", "THE the unseen", "the " * 3000])] + [(None, "the", "", ""), (3, "again", "", "")]


def test_scores_against_plain_counts(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, score string")
    trained = F.coalesce(F.col("doc_id") % 10 != 0, F.lit(True))
    model = H.fit_hmm(docs, trained, states=2, frequent=6, known=20, rounds=5, gain=0.0)
    found = H.score_texts(docs, model).collect()
    learnt = [H.words_of(text) for key, text, *_ in rows if key is None or key % 10]
    counts = Counter(word for words in learnt for word in words) + Counter({b"": len(learnt)})
    tokens, types = sum(counts.values()), len(counts)
    assert model.tokens == tokens and len(found) == len(rows)
    assert len(model.hmm.words) == 6 and len(model.counts) == 21
    assert np.allclose(model.hmm.emit.sum(axis=1), 1) and np.allclose(model.hmm.move.sum(axis=1), 1)
    rare = {word: n for word, n in counts.items() if word and word not in model.hmm.words}
    mass = sum(rare.values()) + 0.1 * (len(rare) + 1)
    assert sum(n + 0.1 for n in rare.values()) + 0.1 == pytest.approx(mass)
    expected = []
    for key, text, *_ in rows:
        words = [*H.words_of(text), b""]
        base = sum(math.log10((counts[w] + 0.1) / (tokens + 0.1 * (types + 1))) for w in words)
        score = packed([model.hmm.numbers(words[:-1])]).log_probabilities(model.hmm)[0]
        score += sum(math.log10((rare.get(w, 0) + 0.1) / mass) for w in words[:-1] if w not in model.hmm.words)
        expected.append((key, len(words), sum(counts[w] > 0 for w in words), base, score))
    order = lambda r: (r[0] is None, r[0], r[1])
    for want, row in zip(sorted(expected, key=order), sorted(map(tuple, found), key=order), strict=True):
        assert row[:3] == want[:3] and row[3:] == pytest.approx(want[3:])
    held = [(row["score"], row["base_score"]) for row in found if row["key"] is not None and row["key"] % 10 == 0 and row["n_tokens"] > 5]
    assert sum(s for s, _ in held) > sum(b for _, b in held)


def test_nothing_to_learn_from(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    model = H.fit_hmm(docs, F.lit(False))
    found = {row["key"]: row for row in H.score_texts(docs, model).collect()}
    assert model.tokens == 0 and found[1]["n_known"] == 0 and found[1]["n_tokens"] == 3
    assert found[1]["base_score"] == pytest.approx(0.0)
    assert H.score_texts(docs.limit(0), model).count() == 0


def test_every_round_sees_all_training_texts(spark, monkeypatch):
    docs = spark.range(9_000).selectExpr("id as doc_id", "concat('w', id % 50, ' v', id % 7, ' u', id) as text")
    seen, one_round = [], H.baum_welch_round
    monkeypatch.setattr(H, "baum_welch_round", lambda texts, *more: seen.append(texts.count()) or one_round(texts, *more))
    H.fit_hmm(docs, F.col("doc_id") % 10 != 0, states=2, frequent=20, known=40, rounds=3, gain=-1.0)
    assert seen == [8_100] * 3


def test_rounds_end_when_nothing_is_gained(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, word string, score string")
    model = H.fit_hmm(docs, F.lit(True), states=3, frequent=6, known=20, rounds=40, gain=0.002)
    steps = np.diff(model.reached)
    assert 3 <= len(model.reached) < 40 and (steps > -1e-3).all()
    assert steps[-1] < 0.002 and (steps[1:-1] >= 0.002).all()
    texts = [H.words_of(text) for _, text, *_ in rows]
    last = H.baum_welch_round(H.numbered_texts(docs.select("text"), model.hmm.words), model.hmm, np.full(8, 1 / 8))[1]
    sums = packed([model.hmm.numbers(words) for words in texts]).log_probabilities(model.hmm)
    assert last == pytest.approx(sums.sum() / sum(len(words) + 1 for words in texts), rel=1e-5)


def test_batches_go_by_length_and_lose_nothing():
    rng = random.Random(7)
    items = ["x" * rng.randint(1, 30) for _ in range(200)]
    batches = list(H.batches_of(iter(items), limit=50, held=400))
    assert sorted(item for batch in batches for item in batch) == sorted(items)
    assert all(sum(map(len, batch)) <= 50 for batch in batches) and len(batches) < 90
    assert all([len(x) for x in batch] == sorted((len(x) for x in batch), reverse=True) for batch in batches)


def test_a_step_of_a_long_text_makes_few_calls(monkeypatch):
    calls = []
    dot = np.dot
    monkeypatch.setattr(H.np, "dot", lambda *args: calls.append(1) or dot(*args))
    model = H.first_model([b"a", b"b"], np.array([3.0, 2.0, 9.0, 8.0]), 3, 5)
    lengths = np.array([1, 200, 7])
    packed = H.Packed(np.tile([2, 3, 1, 0], 52), lengths)
    counts = {"start": np.zeros(3), "move": np.zeros((3, 3)), "emit": np.zeros((3, 4)), "gained": np.zeros(2)}
    packed.expected(model, counts)
    assert 0 < len(calls) <= 3 * 200
    assert counts["start"].sum() == pytest.approx(3, rel=1e-5) and counts["emit"].sum() == pytest.approx(208, rel=1e-5) and counts["move"].sum() == pytest.approx(205, rel=1e-5)
