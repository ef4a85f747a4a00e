"""Removed bytes against a table of all windows, on texts with copies, near copies and shared passages."""

import hashlib
import random

import numpy as np
import pytest

from foldwise.llm import catalog, passages
from foldwise.session import read_table


def brute(rows, length):
    """Spans to remove and bytes left of every (id, text), from the smallest id of every window."""
    least = {}
    for key, text in rows:
        data = (text or "").encode()
        for i in range(len(data) - length + 1):
            window = data[i : i + length]
            least[window] = min(least.get(window, passages.NO_ID), passages.NO_ID if key is None else key)
    answers = []
    for key, text in rows:
        data, gone = (text or "").encode(), set()
        for i in range(len(data) - length + 1):
            if least[data[i : i + length]] < (passages.NO_ID if key is None else key):
                gone.update(range(i, i + length))
        starts = [i for i in sorted(gone) if i - 1 not in gone]
        stops = [i + 1 for i in sorted(gone) if i + 1 not in gone]
        answers.append((key, len(data), tuple(zip(starts, stops)), bytes(b for i, b in enumerate(data) if i not in gone)))
    return sorted(answers, key=str)


def found_rows(docs, **options):
    found = passages.remove_passages(docs, docs.columns, **options)
    return sorted(
        ((row["row"]["doc_id"], row["n_bytes"], tuple(map(tuple, row["spans"])), bytes(row["kept"])) for row in found.collect()), key=str
    )


def copied_corpus(seed, alphabet, n):
    """Random texts, and others put together from their parts with some letters changed."""
    rng, texts = random.Random(seed), []
    for _ in range(n):
        parts = ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 120)))]
        for _ in range(rng.randint(0, 3) if texts else 0):
            source = rng.choice(texts)
            a = rng.randint(0, len(source))
            part = list(source[a : a + rng.randint(0, 150)])
            for _ in range(rng.randint(0, 2) if part else 0):
                part[rng.randrange(len(part))] = rng.choice(alphabet)
            parts.insert(rng.randint(0, len(parts)), "".join(part))
        texts.append("".join(parts))
    keys = rng.sample(range(1000), n)
    return list(zip(keys, texts))


@pytest.mark.parametrize("seed,alphabet,length,crowded", [(1, "abcdefgh \n", 50, 20_000), (2, "ab", 12, 20_000), (3, "aé漢", 20, 2), (4, "ab", 7, 0), (5, "abcd", 50, 1)])
def test_removed_bytes_are_those_of_all_windows(table, seed, alphabet, length, crowded):
    rows = copied_corpus(seed, alphabet, 60)
    docs = table(rows, "doc_id long, text string").repartition(5)
    assert found_rows(docs, length=length, crowded=crowded) == brute(rows, length)


def test_rows_that_meet_within_one_task_and_across_batches(spark, monkeypatch):
    rows = copied_corpus(9, "abcdef", 80) + [(2000 + i, "one passage that many documents share, word for word, to the end" + str(i) * 3) for i in range(90)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert found_rows(docs.coalesce(1), length=30) == brute(rows, 30)
        assert found_rows(docs.repartition(9), length=30, crowded=40) == brute(rows, 30)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_every_window_has_one_anchor_and_equal_windows_the_same():
    rng = random.Random(4)
    texts = [bytes(rng.choice(b"abc") for _ in range(n)) for n in (0, 49, 50, 51, 400, 0, 300, 30)]
    texts.append(texts[4][100:260])
    _, _, text, first, last, at = passages.anchors(texts, 50)
    covered = [(t, i) for t, a, b in zip(text, first, last) for i in range(a, b + 1)]
    assert covered == [(t, i) for t, data in enumerate(texts) for i in range(len(data) - 49)]
    distance = {}
    for t, a, b, place in zip(text, first, last, at):
        for i in range(a, b + 1):
            assert 0 <= place - i <= 50 - 16
            assert distance.setdefault(texts[t][i : i + 50], place - i) == place - i


def test_query_equals_a_table_of_all_windows(spark, small):
    rows = [(row["doc_id"], row["text"]) for row in read_table(spark, small, "documents").collect()]
    found = {tuple(row) for row in catalog.QUERIES["op12_suffix_dedup"](spark, small).collect()}
    digest = lambda data: hashlib.sha256(data).hexdigest()
    assert found == {(key, n, sum(b - a for a, b in spans), len(spans), digest(left)) for key, n, spans, left in brute(rows, 50)}


def test_odd_rows(table):
    long, text = "xy" * 150_000, "a sentence of some seventy bytes, so that it has a few windows of its own"
    rows = [(5, text), (5, text), (5, text + "!"), (None, text), (None, text), (7, None), (8, ""), (9, "short"), (10, long), (11, long + text), (-3, text[3:60])]
    docs = table([(*row, "s") for row in rows], "doc_id long, text string, spans string")
    assert found_rows(docs) == brute(rows, 50)
    assert found_rows(docs.limit(0)) == []
    with pytest.raises(ValueError):
        passages.remove_passages(docs, ["doc_id"], length=200)


def test_ranks_are_equal_for_equal_strings_only():
    data = np.random.default_rng(2).integers(0, 3, 4000).astype(np.uint8)
    ranks, size = passages.BYTES[data], 1
    while size < 16:
        ranks, size = passages.joined(ranks, size), 2 * size
        strings = [data[i : i + size].tobytes() for i in range(len(data) - size + 1)]
        assert len(set(zip(ranks.tolist(), strings))) == len(set(ranks.tolist())) == len(set(strings))
