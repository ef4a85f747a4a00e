"""Held-out accuracy, the update rule, frequencies over all rows, and odd texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import language as L
from foldwise.llm.common import id_remainder

SYLLABLES = {"aa": ["ka", "to", "mi", "ne"], "bb": ["schl", "ung", "ker", "äu"], "cc": ["oui", "eau", "ré", "la"]}


def corpus(n):
    rng = random.Random(8)
    rows = []
    for i in range(n):
        lang = rng.choice(sorted(SYLLABLES))
        words = ["".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(rng.randint(4, 40))]
        rows.append((i, " ".join(words), lang, "score"))
    return rows


def test_held_out_documents_get_their_language(table):
    rows = corpus(400)
    odd = [(900, None, "aa", ""), (901, "12 34 !?", "bb", ""), (902, "", None, ""), (None, "kato mine", None, ""), (904, "½ ² Ⅷ ٣", "aa", ""), (903, "ñandú", None, ""), (5, *rows[5][1:])]
    docs = table(rows + odd, "doc_id long, text string, lang string, score string")
    held_out = id_remainder("doc_id", 4) == 2
    model = L.fit_language(docs, ~held_out, sample_rows=150)
    assert model.languages == ["aa", "bb", "cc"]
    found = L.predict_language(docs, model, docs.columns).withColumn("out", F.crc32(F.col("row.doc_id").cast("string").cast("binary")) % 4 == 2)
    answers = found.collect()
    assert len(answers) == len(rows) + len(odd)
    for row in answers:
        key, source = row["row"]["doc_id"], row["row"]
        assert 0 <= row["score"] <= 1
        if key in (900, 901, 902, 904):
            assert (row["lang_pred"], row["score"]) == (L.UNKNOWN, 0.0)
        elif key is not None and key < 400:
            assert row["lang_pred"] == source["lang"]
    assert sum(bool(row["out"]) for row in answers) > 60
    assert (model.weights == 0).mean() > 0.5  # the elastic net leaves columns without evidence at zero


def test_frequencies_cover_every_row(table):
    texts = ["ab", "ab ab", "xyz", None, "1"]
    docs = table([(text,) for text in texts], "text string")
    frequencies, total = L.document_frequencies(docs, "text", 4096)
    expected = np.zeros(4096)
    for text in texts:
        expected[L.gram_counts(text, 4096)[0]] += 1
    assert total == 5 and np.array_equal(frequencies, expected)


def test_a_single_update_follows_the_rule():
    found, values = np.array([3]), np.array([1.0])
    weights = L.fit_ftrl([(found, values, 0)], 2, 5, 1, alpha=0.5, beta=1.0, l1=0.1, l2=0.01, seed=1)
    g = np.array([-0.5, 0.5])  # two classes, equal at first
    z, n = g, g**2
    expected = (np.sign(z) * 0.1 - z) / ((1 + np.sqrt(n)) / 0.5 + 0.01)
    assert weights[3] == pytest.approx(expected) and not weights[[0, 1, 2, 4]].any()


def test_temperature_is_the_one_of_the_data():
    rng = np.random.default_rng(3)
    scores = rng.normal(size=(4000, 3)) * 2
    labels = np.array([rng.choice(3, p=L.probabilities(row / 2)) for row in scores])
    assert L.best_temperature(scores, labels) == pytest.approx(2, rel=0.15)
    assert L.best_temperature(np.zeros((0, 3)), np.zeros(0, int)) == 1.0


def test_one_language_none_and_no_rows(table):
    docs = table([(1, "abc", "xx"), (2, "abd", None)], "doc_id long, text string, lang string")
    model = L.fit_language(docs, F.lit(True))
    assert [r["lang_pred"] for r in L.predict_language(docs, model, ["doc_id"]).collect()] == ["xx", "xx"]
    empty = L.fit_language(docs, F.lit(False))
    assert [r["lang_pred"] for r in L.predict_language(docs, empty, ["doc_id"]).collect()] == ["und", "und"]
    assert L.predict_language(docs.limit(0), model, ["doc_id"]).count() == 0


def test_letters_are_those_of_category_l():
    assert L.letter_runs("a½b Ⅷx x² ²x 一二 _É9") == ["a", "b", "x", "x", "x", "一二", "é"]
    assert L.letter_runs("½ ² Ⅷ") == [] == L.letter_runs(None)
