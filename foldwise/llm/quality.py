"""Quality rules: statistics of a text, two fixed rules, and an isolation forest over the statistics.

Each tree of the forest isolates the members of a small subsample, drawn by a hash from all documents, by random splits
of random statistics; a document that is isolated after few splits is anomalous. The threshold on the score is calibrated
on all labelled documents: among the cuts that keep the wanted share of good documents, the one that rejects most bad
ones. The forest has a few thousand numbers and travels with the tasks; the documents are read once to be scored for the
threshold and once to be judged, and never shuffled: scores meet the labels, not texts.

Subsamples are chosen by a hash of the id, so they do not depend on partitioning. A null or empty text has no words
and fails the base rules. Labels that are null, conflicting or without a document are ignored; without usable
labels of both kinds, or without documents, nothing but the base rules rejects. Repeated rows are judged alike.
"""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import collect_small, written
from .common import annotate

REPEAT_WINDOW = 8
MIN_WORDS = 20
SCORE_BINS = 4096
SYMBOLS = re.compile(r"[#*$%&|<>]")
LETTERS, CAPITALS, MARKS = re.compile(r"[^\W\d_]+"), re.compile(r"[A-ZÀ-ÖØ-Þ]+"), re.compile(r"[^\w\s]+")
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SHARES = ["symbols", "marks", "capitals", "letters", "mean_word", "short_words", "dup_lines", "repeat_words"]
FIELDS = [
    *[T.StructField(name, T.LongType()) for name in BASE],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("anomaly", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]


def words_of(text: str | None) -> list[bytes]:
    """Splitting bytes at white space cuts at exactly space and U+0009 to U+000D."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


def repeated_words(words: list[bytes], size: int = REPEAT_WINDOW) -> int:
    """Words inside windows of ``size`` words that occur at least twice in the text, the first occurrence included."""
    if len(words) < size + 1:
        return 0
    number: dict[bytes, int] = {}
    window = np.fromiter((number.setdefault(word, len(number)) for word in words), np.int64, len(words))
    covered = 1
    while covered < size:  # equal numbers stand for equal windows of ``covered`` words
        step = min(covered, size - covered)
        pairs = window[:-step] * (int(window.max()) + 1) + window[step:]
        distinct, window = np.unique(pairs, return_inverse=True)
        if len(distinct) == len(pairs):
            return 0
        covered += step
    starts = np.flatnonzero(np.bincount(window)[window] > 1)
    edges = np.zeros(len(words) + 1, np.int64)
    np.add.at(edges, starts, 1)
    np.add.at(edges, starts + size, -1)
    return int((np.cumsum(edges) > 0).sum())


def base_statistics(text: str | None) -> list[int]:
    words = words_of(text)
    lines: set[str] = set()
    duplicates = 0
    for line in (text or "").split("\n"):
        if words_of(line):
            duplicates += line in lines
            lines.add(line)
    chars = len(b"".join(words).decode("utf-8", "surrogatepass"))
    return [len(words), chars, len(SYMBOLS.findall(text or "")), duplicates, repeated_words(words)]


def shares(text: str | None, base: list[int]) -> list[float]:
    """The statistics the forest sees; all relate to the length of the text, so long documents are not odd as such."""
    n, text = max(1, base[0]), text or ""
    letters, capitals, marks = (sum(map(len, kind.findall(text))) for kind in (LETTERS, CAPITALS, MARKS))
    short = sum(len(word) <= 3 for word in words_of(text))
    seen = [base[2] / n, marks / n, capitals / max(1, letters), letters / max(1, base[1]), base[1] / n, short / n]
    return [*seen, base[3] / n, base[4] / n]


def base_failed(base: list[int]) -> bool:
    return base[0] < MIN_WORDS or 100 * base[4] > 30 * base[0]


@dataclass
class Forest:
    """Trees as parallel arrays: column (-1 in a leaf), cut, children, and the path length at a leaf."""

    column: np.ndarray
    cut: np.ndarray
    left: np.ndarray
    right: np.ndarray
    length: np.ndarray
    roots: np.ndarray
    normal: float

    def scores(self, points: np.ndarray) -> np.ndarray:
        """2 ** (-mean path length / the length expected of a normal point): near 1 is odd, below 0.5 is common."""
        total = np.zeros(len(points))
        for root in self.roots:
            node = np.full(len(points), root)
            while True:
                inner = np.flatnonzero(self.column[node] >= 0)
                if not len(inner):
                    break
                at = node[inner]
                low = points[inner, self.column[at]] < self.cut[at]
                node[inner] = np.where(low, self.left[at], self.right[at])
            total += self.length[node]
        return np.power(2.0, -total / max(1, len(self.roots)) / self.normal)


def expected_length(n: int) -> float:
    """Mean path length of an unsuccessful search among n points."""
    return 0.0 if n < 2 else 2 * (math.log(n - 1) + 0.5772156649015329) - 2 * (n - 1) / n


def grow_forest(points: np.ndarray, trees: int, subsample: int, seed: int) -> Forest:
    """Trees over subsamples of the points: each takes the next ones of a shuffled deal, shuffled again when it is used up."""
    rng = np.random.default_rng(seed)
    size = min(subsample, len(points))
    limit = math.ceil(math.log2(max(2, size))) + 2
    nodes: list[list[float]] = []

    def grow(members: np.ndarray, depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, me, me, depth + expected_length(len(members))])
        low, high = members.min(axis=0), members.max(axis=0)
        wide = np.flatnonzero(high > low)
        if depth < limit and len(members) > 1 and len(wide):
            column = int(rng.choice(wide))
            cut = float(rng.uniform(low[column], high[column]))
            below = members[:, column] < cut
            if below.any() and not below.all():
                nodes[me][:4] = [column, cut, grow(members[below], depth + 1), grow(members[~below], depth + 1)]
        return me

    deals = -(-trees * size // max(1, len(points)))
    dealt = np.concatenate([rng.permutation(len(points)) for _ in range(deals)]) if size else np.empty(0, np.int64)
    roots = [grow(points[dealt[tree * size : (tree + 1) * size]], 0) for tree in range(trees)] if size else []
    table = np.array(nodes).reshape(-1, 5)
    whole = [table[:, i].astype(np.int64) for i in (0, 2, 3)]
    return Forest(whole[0], table[:, 1], whole[1], whole[2], table[:, 4], np.array(roots, np.int64), max(1e-9, expected_length(size)))


def calibrated(good: np.ndarray, bad: np.ndarray, keep_share: float) -> float:
    """The cut (a score above it is rejected) that keeps ``keep_share`` of the good and errs least on both kinds."""
    if not len(good) or not len(bad):
        return math.inf
    good, bad = np.sort(good), np.sort(bad)
    cuts = np.unique(np.concatenate([good, bad]))
    cuts = np.append((cuts[:-1] + cuts[1:]) / 2, cuts[-1])
    kept = np.searchsorted(good, cuts, side="right") / len(good)
    passed = np.searchsorted(bad, cuts, side="right") / len(bad)
    allowed = kept >= keep_share
    return float(cuts[allowed][np.argmax((kept - passed)[allowed])])


def calibrated_threshold(scored: DataFrame, keep_share: float) -> float:
    """:func:`calibrated` for a table of ``good`` (boolean) and ``score`` (0 to 1), of any size.

    Counts of a score are summed up over bins of scores, and inside a bin over its scores; only the bins are collected.
    """
    counts = [F.sum(c).alias(c) for c in ("good", "bad")]
    each = scored.select("score", F.col("good").cast("long").alias("good"), (~F.col("good")).cast("long").alias("bad"))
    each = written(each.groupBy("score").agg(*counts).withColumn("bin", F.floor(F.col("score") * SCORE_BINS)))
    bins = collect_small(each.groupBy("bin").agg(*counts, F.min("score").alias("first")).orderBy("bin"), what="bins of scores")
    good, bad = (sum(row[c] for row in bins) for c in ("good", "bad"))
    if not good or not bad:
        return math.inf
    rows, good_before, bad_before = [], 0, 0
    for row, after in zip(bins, [*bins[1:], None]):
        rows.append((row["bin"], good_before, bad_before, after["first"] if after else None))
        good_before, bad_before = good_before + row["good"], bad_before + row["bad"]
    before = scored.sparkSession.createDataFrame(rows, "bin long, good_before long, bad_before long, next_first double")
    inside = Window.partitionBy("bin").orderBy("score")
    following = F.coalesce(F.lead("score").over(inside), "next_first", "score")
    cuts = each.join(F.broadcast(before), "bin").select(
        ((F.col("score") + following) / 2).alias("cut"),
        ((F.col("good_before") + F.sum("good").over(inside)) / F.lit(good)).alias("kept"),
        ((F.col("bad_before") + F.sum("bad").over(inside)) / F.lit(bad)).alias("passed"),
    )
    return cuts.where(F.col("kept") >= F.lit(keep_share)).orderBy((F.col("kept") - F.col("passed")).desc(), "cut").first()["cut"]


@dataclass
class QualityModel:
    forest: Forest
    threshold: float


def fit_quality(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    quality: str = "quality",
    trees: int = 128,
    subsample: int = 64,
    keep_share: float = 0.998,
    seed: int = 7,
) -> QualityModel:
    """Fit each of the ``trees`` on ``subsample`` documents, drawn from all, and calibrate on all labelled ones."""
    draw = F.xxhash64(F.lit(seed), F.col("key"))
    keyed = docs.select(F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"))
    verdicts = (
        labels.select(F.col(key).cast("string").alias("key"), F.col(quality).cast("int").alias("quality"))
        .where("key is not null and quality is not null")
        .groupBy("key")
        .agg(F.min("quality").alias("quality"), F.max("quality").alias("other"))
        .where("quality = other")
    )
    chosen = keyed.select("key").where("key is not null").orderBy(draw, "key").limit(trees * subsample).distinct()
    wanted = keyed.join(F.broadcast(chosen), "key").dropDuplicates(["key"]).withColumn("draw", draw)  # they are bounded

    def start():
        return lambda batch: {"shares": [shares(value, base_statistics(value)) for value in batch.column("text").to_pylist()]}

    fields = [T.StructField("shares", T.ArrayType(T.DoubleType()))]
    rows = annotate(wanted, ["draw", "key"], {"text": F.col("text")}, start, fields).orderBy("row.draw", "row.key").collect()
    forest = grow_forest(np.array([row["shares"] for row in rows]).reshape(-1, len(SHARES)), trees, subsample, seed)
    judged = judge_quality(keyed, QualityModel(forest, math.inf), ["key"]).select("row.key", F.struct("base_failed", "anomaly").alias("found"))
    labelled = judged.join(verdicts.where("quality in (0, 1)"), "key").groupBy("key").agg(F.min("found").alias("found"), F.min("quality").alias("quality"))
    scored = labelled.where(~F.col("found.base_failed")).select((F.col("quality") == 1).alias("good"), F.col("found.anomaly").alias("score"))
    return QualityModel(forest, calibrated_threshold(scored, keep_share))


def judge_quality(docs: DataFrame, model: QualityModel, keep: list[str], text: str = "text") -> DataFrame:
    """Documents as ``row``, with the base statistics, ``base_failed``, the ``anomaly`` score and ``kept``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted = shared.value

        def process(batch):
            values = batch.column("text").to_pylist()
            found = [base_statistics(value) for value in values]
            points = [shares(value, base) for value, base in zip(values, found, strict=True)]
            score = fitted.forest.scores(np.array(points))
            failed = np.array([base_failed(base) for base in found])
            made = {name: [base[i] for base in found] for i, name in enumerate(BASE)}
            return made | {"base_failed": failed, "anomaly": score, "kept": ~failed & (score <= fitted.threshold)}

        return process

    return annotate(docs, keep, {"text": F.col(text).cast("string")}, start, FIELDS)
