"""Periodic runs of words inside each text, found by seeds on diagonals that are extended both ways.

A run of period q is a maximal stretch in which words q apart are equal, at least ``max(12, 2q)`` words long, with q its
smallest period. On the diagonal of lag q (word i against word i + q) it is a stretch of at least ``max(12 - q, q)``
equal words, and that is the guaranteed overlap which the seeds are made for:

* Lags up to 7 are few, and their diagonals are compared as a whole.
* A lag from 2B to 4B - 1, B = 4, 8, 16, ..., has a stretch of 2B words or more, which holds a whole block of B words
  that starts at a multiple of B. So the B-grams are indexed (numbered by doubling, so equal numbers are equal words),
  and each such block is paired with the later occurrences of its gram at those lags. That is at most 2B pairs for
  each of n/B blocks, however repetitive the text is.

Seeds that follow one another on a lag lie in one stretch, so only the first and the last of such a chain is extended,
by fewer than B words: the furthest word covered on a lag is never passed twice. Of stretches with equal start and
length the one with the smallest lag is the run; the others have a multiple of its period.

A text is handled inside its own row, in memory that grows with its words, without a shuffle. A null, empty or blank
text has no words and no run. Repeated rows get the same result, an empty table gives an empty one, and kept columns
travel in a struct, so their names cannot clash. A null id counts as the empty text where the id is used.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate

SHORTEST = 12
DIRECT = 7
FIRST_BLOCK = 4


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split() if text else []


def numbered(words: list[bytes]) -> np.ndarray:
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(word, len(known)) for word in words), np.int64, len(words))


def stretches(equal: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start and end of each run of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate([[False], equal, [False]]).astype(np.int8)))
    return edges[::2], edges[1::2]


def doubled(grams: np.ndarray, size: int) -> np.ndarray:
    """Numbers of the grams of twice the size, one for each place where such a gram starts."""
    pairs = grams[:-size].astype(np.int64) * (int(grams.max()) + 1) + grams[size:]
    return np.unique(pairs, return_inverse=True)[1].astype(np.int32)


def seeds(grams: np.ndarray, block: int) -> tuple[np.ndarray, np.ndarray]:
    """(lag, start) of each aligned block that occurs again at a lag from 2 to 4 blocks, sorted."""
    size, grams = len(grams), grams.astype(np.int64)
    keys = grams * size + np.arange(size)
    keys.sort()
    start = np.arange(0, size, block)
    base = grams[start] * size
    low = np.searchsorted(keys, base + np.minimum(start + 2 * block, size))
    high = np.searchsorted(keys, base + np.minimum(start + 4 * block, size))
    many = high - low
    owner = np.repeat(np.arange(len(start)), many)
    place = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many) + low[owner]
    lag = keys[place] - base[owner] - start[owner]
    order = np.lexsort((start[owner], lag))
    return lag[order], start[owner][order]


def reach(levels: list[np.ndarray], at: np.ndarray, lag: np.ndarray, forward: bool) -> np.ndarray:
    """How many words from ``at`` on (or before it) are equal to those ``lag`` later, below twice the largest gram."""
    moved = np.zeros(len(at), np.int64)
    for depth in range(len(levels) - 1, -1, -1):
        grams, size = levels[depth], 1 << depth
        left = at + moved if forward else at - moved - size
        inside = np.flatnonzero((left >= 0) & (left + lag < len(grams)))
        same = inside[grams[left[inside]] == grams[left[inside] + lag[inside]]]
        moved[same] += size
    return moved


def all_runs(words: np.ndarray, shortest: int = SHORTEST) -> np.ndarray:
    """Rows (start, length, period) of all runs, sorted by start and then period."""
    n, found = len(words), []
    for lag in range(1, min(DIRECT, n // 2) + 1):
        low, high = stretches(words[lag:] == words[:-lag])
        long = high - low >= max(shortest - lag, lag)
        found.append(np.column_stack([low[long], high[long] - low[long] + lag, np.full(int(long.sum()), lag)]))
    levels, block = [words], FIRST_BLOCK
    while 4 * block <= n:
        while 1 << (len(levels) - 1) < block:
            levels.append(doubled(levels[-1], 1 << (len(levels) - 1)))
        grams = levels[-1]
        if int(grams.max()) + 1 == len(grams):
            break  # no gram of this size occurs twice, so none of a larger size does
        lag, start = seeds(grams, block)
        if len(lag):
            heads = np.flatnonzero(np.append(True, (lag[1:] != lag[:-1]) | (start[1:] != start[:-1] + block)))
            lags, low = lag[heads], start[heads]
            high = start[np.append(heads[1:], len(lag)) - 1] + block
            low = low - reach(levels[:-1], low, lags, forward=False)
            high = high + reach(levels[:-1], high, lags, forward=True)
            long = high - low >= np.maximum(shortest - lags, lags)
            found.append(np.column_stack([low, high - low + lags, lags])[long])
        block *= 2
    runs = np.concatenate(found) if found else np.empty((0, 3), np.int64)
    if not len(runs):
        return runs
    runs = runs[np.lexsort((runs[:, 2], runs[:, 1], runs[:, 0]))]
    runs = runs[np.append(True, (runs[1:, :2] != runs[:-1, :2]).any(axis=1))]
    return runs[np.lexsort((runs[:, 2], runs[:, 0]))]


def kept_words(runs: np.ndarray, n: int) -> np.ndarray:
    """False for each word that some run holds after its first period."""
    steps = np.zeros(n + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    return np.cumsum(steps[:-1]) == 0


def longest_run(runs: np.ndarray) -> tuple[int, int, int] | None:
    """The run of greatest length; ties go to the smallest start, then the smallest period."""
    if not len(runs):
        return None
    return tuple(runs[np.lexsort((runs[:, 2], runs[:, 0], -runs[:, 1]))[0]].tolist())


RUN = T.StructType([T.StructField(name, T.LongType()) for name in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("longest", RUN),
    T.StructField("collapsed", T.StringType()),
]


def find_runs(
    docs: DataFrame,
    keep: list[str],
    key: str = "doc_id",
    text: str = "text",
    shortest: int = SHORTEST,
    rewrite: Callable[[str, list[bytes]], list[bytes]] | None = None,
) -> DataFrame:
    """Documents as ``row``, with ``n_words``, all ``runs``, the ``longest`` (null: none) and the ``collapsed`` text.

    Collapsed is the text without the words that a run repeats, joined by single blanks. ``rewrite`` may change the
    words of a text, given its id as text, before they are searched.
    """

    def one(name: str | None, value: str | None) -> tuple:
        words = words_of(value)
        if rewrite:
            words = rewrite(name or "", words)
        runs = all_runs(numbered(words), shortest)
        if len(runs):
            left = [words[i] for i in np.flatnonzero(kept_words(runs, len(words))).tolist()]
            return len(words), list(map(tuple, runs.tolist())), longest_run(runs), b" ".join(left)
        return len(words), [], None, b" ".join(words)

    def start():
        def process(batch):
            columns = zip(*map(one, batch.column("key").to_pylist(), batch.column("text").to_pylist()))
            return dict(zip((field.name for field in FIELDS), columns, strict=True))

        return process

    inputs = {"key": F.col(key).cast("string"), "text": F.col(text).cast("string")}
    return annotate(docs, keep, inputs, start, FIELDS)
