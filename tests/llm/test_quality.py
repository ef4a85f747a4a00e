"""Base statistics by their definition, forests on planted anomalies, and odd tables."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from foldwise.llm import quality as Q


def plain_statistics(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    counts, hit = Counter(windows), set()
    for i, window in enumerate(windows):
        if counts[window] > 1:
            hit.update(range(i, i + 8))
    lines = [line for line in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", line)]
    return [len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit)]


def texts():
    rng = random.Random(4)
    say = lambda n, k: " ".join(rng.choice("abcdefgh"[:k]) for _ in range(n))
    return [None, "", " \n\t", "é # x\nx\nx\n\nx ", "a\x85b\u00a0c d\u2003e", "one two", say(9, 1), say(17, 2), say(400, 2), say(3000, 3),
            "\n".join([say(9, 5), say(3, 5)] * 3), "🙂 " * 30, "a b c d e f g h " * 2, "a b c d e f g h i"]


def test_base_statistics_follow_their_definition():
    for text in texts():
        assert Q.base_statistics(text) == plain_statistics(text), text


@pytest.mark.parametrize("size", [1, 2, 3, 5, 8, 11])
def test_repeated_windows_of_any_size(size):
    rng = random.Random(size)
    words = [rng.choice([b"a", b"b", b"c"]) for _ in range(60)]
    windows = [tuple(words[i : i + size]) for i in range(len(words) - size + 1)]
    hit = {i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(size)}
    assert Q.repeated_words(words, size) == len(hit)


def test_forest_puts_far_points_first_and_path_lengths_match_a_walk():
    rng = np.random.default_rng(1)
    points = np.vstack([rng.normal(size=(500, 3)), rng.normal(8, 0.1, size=(5, 3))])
    forest = Q.grow_forest(points, 40, 64, seed=2)
    scores = forest.scores(points)
    assert scores[500:].min() > np.quantile(scores[:500], 0.95)
    for i in (0, 77, 502):
        total = 0.0
        for node in forest.roots:
            while forest.column[node] >= 0:
                node = forest.left[node] if points[i, forest.column[node]] < forest.cut[node] else forest.right[node]
            total += forest.length[node]
        assert scores[i] == pytest.approx(2 ** (-total / len(forest.roots) / forest.normal))


def test_threshold_keeps_the_wanted_share():
    good, bad = np.linspace(0, 1, 1001), np.array([0.2, 0.9995, 2, 3])
    cut = Q.calibrated(good, bad, 0.99)
    assert (good <= cut).mean() >= 0.99 and (bad > cut).sum() == 3
    assert Q.calibrated(good, np.array([]), 0.99) == math.inf


@pytest.mark.parametrize("bins", [1, 7, 4096])
def test_threshold_over_all_scores_is_the_one_of_the_arrays(spark, monkeypatch, bins):
    monkeypatch.setattr(Q, "SCORE_BINS", bins)
    rng = np.random.default_rng(bins)
    good, bad = (np.round(rng.beta(*shape, size=n), 3) for shape, n in (((4, 6), 20_000), ((6, 4), 3_000)))
    scored = spark.createDataFrame([(True, s) for s in good.tolist()] + [(False, s) for s in bad.tolist()], "good boolean, score double")
    for share in (0.9, 0.998, 1.0):
        assert Q.calibrated_threshold(scored, share) == Q.calibrated(good, bad, share)
    assert Q.calibrated_threshold(scored.where("good"), 0.9) == math.inf


def test_every_label_counts_for_the_threshold(spark):
    """More labels than any bound of a sample: the cut is the one of all scores."""
    text = F.concat_ws(" ", F.transform(F.sequence(F.lit(1), F.lit(30)), lambda i: F.concat(F.lit("w"), i, F.when(i < F.col("id") % 13, F.lit("#")).otherwise(F.lit("")))))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), text.alias("text"))
    labels = docs.select("doc_id", F.when((F.col("doc_id") % 13 > 8) | (F.col("doc_id") % 5 == 0), F.lit(0)).otherwise(F.lit(1)).alias("quality"))
    model = Q.fit_quality(docs, labels)
    judged = Q.judge_quality(docs, model, ["doc_id"]).select("row.doc_id", "anomaly", "base_failed").join(labels, "doc_id").toPandas()
    judged = judged[~judged["base_failed"]]
    good, bad = (judged.loc[judged["quality"] == q, "anomaly"].to_numpy() for q in (1, 0))
    assert len(judged) > 8192 and model.threshold == Q.calibrated(good, bad, 0.998)


def corpus():
    rng = random.Random(6)
    vocabulary = ["".join(rng.choice("abcdefghilmnorstu") for _ in range(rng.randint(2, 8))) for _ in range(900)]
    clean = [(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(40, 90))) + ".").capitalize() for _ in range(260)]
    junk = [" ".join(rng.choice(vocabulary) + rng.choice(["***", "###", "$$$"]) for _ in range(60)) for _ in range(25)]
    return clean, junk


def test_junk_goes_clean_stays(table):
    clean, junk = corpus()
    rows = [(i, text, "kept", 1) for i, text in enumerate(clean + junk)] + [(None, clean[0], "", 0), (5, clean[5], "kept", 1), (900, None, "", 0)]
    docs = table(rows, "doc_id long, text string, kept string, n_words int")
    labels = [(i, int(i < 260), 0) for i in range(0, 285)] + [(None, 1, 0), (3, None, 0), (4, 0, 0), (7777, 0, 0)]
    model = Q.fit_quality(docs, table(labels, "doc_id long, quality int, toxic int"))
    judged = Q.judge_quality(docs, model, docs.columns).collect()
    assert len(judged) == len(rows)
    kept = {row["row"]["doc_id"]: row["kept"] for row in judged}
    assert not any(kept[i] for i in range(260, 285)) and not kept[900]
    assert sum(kept[i] for i in range(260)) >= 258 and kept[None]


def test_without_labels_or_documents_only_base_rules_count(table):
    docs = table([(1, "a b"), (2, " ".join(map(str, range(30)))), (3, None)], "doc_id long, text string")
    labels = table([], "doc_id long, quality int")
    for fitted_on in (docs, docs.limit(0)):
        model = Q.fit_quality(fitted_on, labels)
        assert {r["row"]["doc_id"]: r["kept"] for r in Q.judge_quality(docs, model, ["doc_id"]).collect()} == {1: False, 2: True, 3: False}
    assert Q.judge_quality(docs.limit(0), model, ["doc_id"]).count() == 0
