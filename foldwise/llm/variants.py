"""Spelling variants of the words of a corpus: near pairs by asymmetric q-chunks, and the form each word stands for.

Words are counted in the tasks first, so a frequent word is one row of a task. Two words are near when one inserted,
deleted or replaced code point turns one into the other. The shorter one, of length L, contributes two disjoint chunks,
its halves. One edit leaves a half as it is, and the longer one then holds it as a gram at the same place, or, behind
the edit, shifted by the difference of the lengths, which is at most one. Grams at other places can meet no chunk and
are left out of the positional grams of the longer word.

A half alone is shared by too many words. The half with the edit is cut in two as well, and by the same argument one
of these chunks is preserved; both preserved chunks together are the key of the join. So a word has four keys as the
shorter one and eight as the longer one, words that meet have three quarters in common, and every near pair meets.
Pairs that meet are verified inside the join, so only near pairs leave it.

A word's form is its near word with the largest count (ties: the smallest in code-point order), if that count is at
least ``ratio`` times the word's own. Along forms the count grows by that ratio, so forms have no circle and chains are
short; the root is found by pointer jumping, each round on the reliable checkpoint of the one before.

A null or empty text has no words; repeated rows count again; an empty table has no words. Only the id and the text are
read, so other columns cannot clash. A null id counts as the empty text where the id is used. A text is handled inside
its own row; counts leave a task whenever ``flush`` different words are held, whatever the length of the texts.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

LETTERS = "a-zÀ-ÿ"  # after A-Z are lower-cased
LEAST_LENGTH = 7
LEAST_COUNT = 2
RATIO = 10
KINDS = 4


def letter_runs(text: str, least: int = LEAST_LENGTH) -> list[str]:
    """Maximal runs of at least ``least`` letters, with A-Z lower-cased."""
    lower = text.encode("utf-8", "surrogatepass").lower().decode("utf-8", "surrogatepass")
    return re.findall(f"[{LETTERS}]{{{least},}}", lower)


def count_words(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    rewrite: Callable[[str], Callable[[str], str]] | None = None,
    flush: int = 400_000,
) -> DataFrame:
    """(word, n) of all words of enough code points that occur often enough over all texts.

    ``rewrite`` gives, for an id as text, what becomes of a run in that text; it may shorten runs, not lengthen them.
    """
    rows = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            columns = [pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int64())]
            return pa.RecordBatch.from_arrays(columns, names=["word", "n"])

        for batch in batches:
            for name, value in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist()):
                runs = letter_runs(value, least_length) if value else []
                if rewrite:
                    change = rewrite(name or "")
                    for word, times in Counter(runs).items():
                        if len(word := change(word)) >= least_length:
                            counts[word] += times
                else:
                    counts.update(runs)
                if len(counts) > flush:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    counted = rows.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.where(F.col("n") >= least_count)


def keys_of(word: Column, length: Column, shift: int) -> list[Column]:
    """The four keys under which ``word`` meets words of ``length`` that are shorter than it by ``shift``."""
    half = F.floor(length / 2).cast("int")
    early, late = F.floor(half / 2).cast("int"), F.floor((length - half) / 2).cast("int")

    def head(end: Column) -> Column:
        return F.substring(word, F.lit(1), end)

    def tail(start: Column) -> Column:
        return F.substring(word, start + (1 + shift), length)

    preserved = [
        head(half + late),  # the edit is in the last quarter
        F.concat(head(half), tail(half + late)),  # in the third
        F.concat(head(early), tail(half)),  # in the second
        tail(early),  # in the first
    ]
    return [F.xxhash64(length, F.lit(kind), part) for kind, part in enumerate(preserved)]


def near_pairs(words: DataFrame) -> DataFrame:
    """(a, n_a, b, n_b) for each pair of different words one edit apart, once; ``words`` has word and n, each word once."""
    word, length = F.col("word"), F.length("word")
    own = F.explode(F.array(*keys_of(word, length, 0))).alias("at")
    longer = F.explode(F.array(*keys_of(word, length - 1, 1))).alias("at")
    short = words.select(own, F.col("word").alias("a"), F.col("n").alias("n_a"))
    long = words.select(own, F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(False).alias("inserted"))
    long = long.unionAll(words.where(length > 1).select(longer, F.col("word").alias("b"), F.col("n").alias("n_b"), F.lit(True).alias("inserted")))
    once = F.col("inserted") | (F.col("a") < F.col("b"))
    met = short.join(long, (short["at"] == long["at"]) & once & (F.levenshtein("a", "b", 1) == 1))
    return met.select("a", "n_a", "b", "n_b").distinct()


def roots_of(forms: DataFrame) -> DataFrame:
    """(word, root) for every row of (word, form): where the chain of forms ends."""
    roots = reliable_checkpoint(forms.select("word", F.col("form").alias("root")))
    while True:
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("next"))
        jumped = roots.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved"))
        jumped = reliable_checkpoint(jumped)
        if jumped.where("moved").isEmpty():
            return jumped.select("word", "root")
        roots = jumped.select("word", "root")


def group_variants(words: DataFrame, ratio: int = RATIO) -> DataFrame:
    """``word``, ``n``, ``n_near``, ``form``, ``form_n`` and ``root`` of each row of (word, n)."""
    words = reliable_checkpoint(words.select("word", "n"))
    pairs = near_pairs(words)
    sides = F.explode(
        F.array(
            F.struct(F.col("a").alias("word"), F.col("b").alias("other"), F.col("n_b").alias("other_n")),
            F.struct(F.col("b").alias("word"), F.col("a").alias("other"), F.col("n_a").alias("other_n")),
        )
    ).alias("side")
    best = F.min(F.struct((-F.col("other_n")).alias("rank"), "other")).alias("best")
    near = pairs.select(sides).select("side.*").groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), best)
    chosen = -F.col("best.rank") >= ratio * F.col("n")
    placed = words.join(near, "word", "left").select(
        "word",
        "n",
        F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(chosen, F.col("best.other")).alias("form"),
        F.when(chosen, -F.col("best.rank")).alias("form_n"),
    )
    placed = reliable_checkpoint(placed)
    roots = roots_of(placed.where("form is not null"))
    return placed.join(roots, "word", "left").withColumn("root", F.coalesce("root", "word"))
