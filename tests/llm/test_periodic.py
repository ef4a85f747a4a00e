"""Runs against a search over all periods, digests against plain Python, and odd texts."""

import hashlib
import zlib

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from foldwise.llm import catalog, periodic
from foldwise.session import read_table


def brute(words):
    """Every maximal stretch of every period, kept when no smaller period fits."""
    n, found = len(words), []
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            if words[i] != words[i + q]:
                i += 1
                continue
            start = i
            while i + q < n and words[i] == words[i + q]:
                i += 1
            length = i + q - start
            part = words[start : start + length]
            if length >= max(12, 2 * q) and not any(part[p:] == part[:-p] for p in range(1, q)):
                found.append((start, length, q))
    return sorted(found)


def planted(key, text):
    words = (text or "").encode().split()
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    return words


def expected(key, text):
    words = planted(key, text)
    runs = brute(words)
    dropped = {i for start, length, q in runs for i in range(start + q, start + length)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else None
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs)
    kept = b" ".join(word for i, word in enumerate(words) if i not in dropped)
    one = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *one, hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest())


@st.composite
def repetitive(draw):
    """Words put together from repeated blocks, so that runs nest, touch and overlap."""
    words = []
    for _ in range(draw(st.integers(1, 5))):
        block = draw(st.lists(st.integers(0, 2), min_size=1, max_size=14))
        words += block * draw(st.integers(1, 7)) + block[: draw(st.integers(0, len(block)))]
        words += draw(st.lists(st.integers(0, 3), max_size=4))
    return words


@settings(max_examples=400, deadline=None)
@given(st.one_of(repetitive(), st.lists(st.integers(0, 1), max_size=70)))
def test_runs_are_those_of_a_search_over_all_periods(words):
    found = periodic.all_runs(np.array(words, np.int64))
    assert list(map(tuple, found.tolist())) == brute(words)
    kept = periodic.kept_words(found, len(words)).tolist()
    assert kept == [not any(s + q <= i < s + n for s, n, q in found.tolist()) for i in range(len(words))]


def test_seeds_stay_in_proportion_on_the_most_repetitive_texts():
    words = np.zeros(200_000, np.int64)
    assert periodic.all_runs(words).tolist() == [[0, 200_000, 1]]
    assert all(len(periodic.seeds(words[: 1 << 14], block)[0]) <= 2 << 14 for block in (4, 64, 1024))
    nested = np.tile(np.append(np.zeros(500, np.int64), np.arange(1, 301)), 60)
    found = periodic.all_runs(nested).tolist()
    assert [0, 48_000, 800] in found and len(found) == 61


def test_a_period_of_half_a_long_text_is_found():
    block = np.random.default_rng(1).integers(0, 10**6, 50_000)
    assert periodic.all_runs(np.append(block, block)).tolist() == [[0, 100_000, 50_000]]
    assert not len(periodic.all_runs(np.append(block, block[:-1])))


def test_query_equals_plain_python(spark, small):
    rows = read_table(spark, small, "documents").collect()
    found = {tuple(row) for row in catalog.QUERIES["op11_periodic_runs"](spark, small).collect()}
    assert found == {(row["doc_id"], *expected(str(row["doc_id"]), row["text"])) for row in rows}


def test_odd_rows(spark, table):
    text = "x " + "a b c " * 9
    rows = [(1, text, "r"), (1, text, "r"), (None, text, None), (2, None, "r"), (3, "", "r"), (4, " \t\n", "r"), (5, "é\u00a0é ü", "r")]
    docs = table(rows, "doc_id long, text string, runs string")
    found = periodic.find_runs(docs, docs.columns).collect()
    assert len(found) == len(rows)
    for row in found:
        key, runs = row["row"]["doc_id"], [tuple(run) for run in row["runs"]]
        if key in (1, None):
            assert (runs, tuple(row["longest"]), row["collapsed"]) == ([(1, 27, 3)], (1, 27, 3), "x a b c")
        else:
            assert (runs, row["longest"]) == ([], None)
            assert (row["n_words"], row["collapsed"]) == {5: (2, "é\u00a0é ü")}.get(key, (0, ""))
    assert periodic.find_runs(docs.limit(0), ["doc_id"]).count() == 0
