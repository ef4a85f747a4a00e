"""Language of a text by sparse multinomial logistic regression on TF-IDF weighted character n-grams.

Runs of letters, lower-cased and set apart by single blanks, are cut into 1-, 2- and 3-grams of code points, which
are hashed into a fixed number of columns. Document frequencies are counted over all training documents. The
weights are fitted with follow-the-regularised-leader: each column keeps a sum of adjusted gradients and one of
squared gradients, and the elastic net (L1 and L2) sets columns without evidence to exactly zero. A temperature,
found on a part of the sample that the fit never saw, turns the scores into calibrated probabilities.

The fit uses a bounded sample of labelled training documents (``sample_rows`` in all, shared out evenly between the
languages; whole texts); frequencies and predictions cover every document. The model is columns x languages numbers.

A null text, or one without a letter, is ``und`` with score 0. Documents with a null language or a null id are never
trained on if so marked by ``trained``; with no usable training document every text is ``und``. One language gives
that language with score 1. Repeated rows are predicted alike.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, small_batches

COLUMNS = 1 << 15
UNKNOWN = "und"
LETTERS = re.compile(r"[^\W\d_]+")  # letters, and numbers that are no digits, such as fractions
MIX = np.array([2654435761, 2246822519, 3266489917, 668265263], np.uint64)  # odd multipliers of the n-gram hash
FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]


def letter_runs(text: str | None) -> list[str]:
    """Runs of letters (Unicode's category L), lower-cased."""
    runs = LETTERS.findall(text.lower()) if text else []
    if all(map(str.isalpha, runs)):
        return runs
    return [part for run in runs for part in "".join(c if c.isalpha() else " " for c in run).split()]


def gram_counts(text: str | None, columns: int = COLUMNS) -> tuple[np.ndarray, np.ndarray]:
    """Hashed columns of the n-grams of a text, ascending, and how often each occurs."""
    runs = letter_runs(text)
    if not runs:
        return np.zeros(0, np.int64), np.zeros(0)
    points = np.frombuffer(f" {' '.join(runs)} ".encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    hashes, grams = [], np.zeros(len(points), np.uint64)
    for size in range(1, min(3, len(points)) + 1):
        grams = (grams[: len(points) - size + 1] + points[size - 1 :]) * MIX[size - 1]
        hashes.append(((grams ^ (grams >> np.uint64(29))) * MIX[3]) >> np.uint64(17))
    counts = np.bincount((np.concatenate(hashes) % np.uint64(columns)).astype(np.int64), minlength=columns)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


def weighted(counts: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Logarithmic term frequency times idf, scaled to length one."""
    values = (1 + np.log(counts)) * idf
    return values / max(1e-12, float(np.sqrt(values @ values)))


def probabilities(scores: np.ndarray) -> np.ndarray:
    shifted = np.exp(scores - scores.max(axis=-1, keepdims=True))
    return shifted / shifted.sum(axis=-1, keepdims=True)


@dataclass
class LanguageModel:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float

    def predict(self, text: str | None) -> tuple[str, float]:
        found, counts = gram_counts(text, len(self.idf))
        if not len(found) or not self.languages:
            return UNKNOWN, 0.0
        scores = weighted(counts, self.idf[found]) @ self.weights[found]
        chances = probabilities(scores / self.temperature)
        best = int(chances.argmax())
        return self.languages[best], float(min(1.0, chances[best]))


def document_frequencies(texts: DataFrame, text: str, columns: int) -> tuple[np.ndarray, int]:
    """In how many texts each column occurs, over the whole table: one partial sum per task, one row per column."""

    def run(batches):
        total, rows = np.zeros(columns, np.int64), 0
        for batch in small_batches(batches):
            for value in batch.column(0).to_pylist():
                found, _ = gram_counts(value, columns)
                total[found] += 1
                rows += 1
        if rows:
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_pydict({"gram": np.append(used, -1), "docs": np.append(total[used], rows)})

    parts = texts.select(F.col(text).cast("string")).mapInArrow(run, "gram long, docs long")
    rows = parts.groupBy("gram").agg(F.sum("docs").alias("docs")).collect()  # at most ``columns`` + 1 rows
    frequencies = np.zeros(columns + 1, np.int64)
    for row in rows:
        frequencies[row["gram"]] = row["docs"]
    return frequencies[:columns], int(frequencies[columns])


def fit_ftrl(
    examples: list[tuple[np.ndarray, np.ndarray, int]],
    classes: int,
    columns: int,
    epochs: int,
    alpha: float,
    beta: float,
    l1: float,
    l2: float,
    seed: int,
) -> np.ndarray:
    """Per-coordinate FTRL-proximal over single examples, in a seeded order."""
    sums, squares = np.zeros((columns, classes)), np.zeros((columns, classes))

    def solved(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((beta + np.sqrt(n)) / alpha + l2))

    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        for i in rng.permutation(len(examples)):
            found, values, label = examples[i]
            weights = solved(sums[found], squares[found])
            error = probabilities(values @ weights)
            error[label] -= 1
            gradient = values[:, None] * error[None, :]
            grown = squares[found] + gradient**2
            sums[found] += gradient - (np.sqrt(grown) - np.sqrt(squares[found])) / alpha * weights
            squares[found] = grown
    return solved(sums, squares)


def best_temperature(scores: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the smallest mean log loss, on a geometric grid."""
    if not len(scores):
        return 1.0
    grid = np.geomspace(0.05, 20, 121)
    losses = [-np.log(np.maximum(probabilities(scores / t)[np.arange(len(labels)), labels], 1e-12)).mean() for t in grid]
    return float(grid[int(np.argmin(losses))])


def fit_language(
    docs: DataFrame,
    trained: Column,
    key: str = "doc_id",
    text: str = "text",
    lang: str = "lang",
    columns: int = COLUMNS,
    sample_rows: int = 2048,
    epochs: int = 3,
    alpha: float = 0.5,
    beta: float = 1.0,
    l1: float = 0.02,
    l2: float = 0.001,
    seed: int = 9,
) -> LanguageModel:
    """Learn from the rows where ``trained`` holds and the language is known."""
    rows = docs.where(trained).where(F.col(lang).isNotNull()).select(
        F.col(key).cast("string").alias("key"), F.col(text).cast("string").alias("text"), F.col(lang).cast("string").alias("lang")
    )
    draw = F.xxhash64(F.lit(seed), F.col("key"), F.col("lang"))
    languages = sorted(row["lang"] for row in rows.select("lang").distinct().collect())
    frequencies, total = document_frequencies(rows, "text", columns)
    share = max(1, sample_rows // max(1, len(languages)))
    # the limit in the window is pushed below the shuffle, so a task keeps ``share`` keys per language
    best = rows.select("key", "lang", draw.alias("draw")).withColumn(
        "place", F.row_number().over(Window.partitionBy("lang").orderBy("draw", "key"))
    )
    chosen = best.where(F.col("place") <= share).select("key", "lang").distinct()
    sample = rows.join(F.broadcast(chosen), ["key", "lang"]).dropDuplicates(["key", "lang"])

    def start():
        def process(batch):
            found = [gram_counts(value, columns) for value in batch.column("text").to_pylist()]
            return {"found": [x.tolist() for x, _ in found], "counts": [x.tolist() for _, x in found]}

        return process

    fields = [T.StructField("found", T.ArrayType(T.IntegerType())), T.StructField("counts", T.ArrayType(T.FloatType()))]
    taken = annotate(sample, ["key", "lang"], {"text": F.col("text")}, start, fields)
    idf = np.log((1 + total) / (1 + frequencies)) + 1
    place = {name: i for i, name in enumerate(languages)}
    examples = []
    table = taken.select("row.lang", "row.key", "found", "counts").orderBy("lang", "key").toArrow().combine_chunks()
    for name, columns_of, counts in zip(*[table.column(c) for c in ("lang", "found", "counts")], strict=True):
        found = columns_of.values.to_numpy(zero_copy_only=False).astype(np.int64)
        if len(found):
            examples.append((found, weighted(counts.values.to_numpy(zero_copy_only=False).astype(float), idf[found]), place[name.as_py()]))
    order = np.random.default_rng(seed).permutation(len(examples))
    held = [examples[i] for i in order[: len(examples) // 5]]
    fitted = [examples[i] for i in order[len(examples) // 5 :]]
    if not fitted:
        languages = []
    weights = fit_ftrl(fitted, len(languages), columns, epochs, alpha, beta, l1, l2, seed) if languages else np.zeros((columns, 0))
    scores = np.array([values @ weights[found] for found, values, _ in held]) if languages else np.zeros(0)
    return LanguageModel(languages, idf, weights, best_temperature(scores, np.array([label for *_, label in held], np.int64)))


def predict_language(docs: DataFrame, model: LanguageModel, keep: list[str], text: str = "text") -> DataFrame:
    """Documents as ``row``, with ``lang_pred`` and its calibrated probability ``score``."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def start():
        fitted = shared.value

        def process(batch):
            found = [fitted.predict(value) for value in batch.column("text").to_pylist()]
            return {"lang_pred": [name for name, _ in found], "score": [score for _, score in found]}

        return process

    return annotate(docs, keep, {"text": F.col(text).cast("string")}, start, FIELDS)
