"""A hidden Markov language model, trained by Baum-Welch over all training texts, that scores whole texts exactly.

Tokens are words with A-Z lower-cased, and one end per text. The ``frequent`` words with the highest counts have an
emission probability of their own in every state; all other words share one class whose emission a state learns, times
the word's share of the class by its (smoothed) count. Unseen words are one further type of that class. So every token
has a probability, and the probabilities of all types sum to one in every state.

Counts of words are taken over the whole corpus, and the training texts are written once as numbers of words. Each round
of Baum-Welch sends the model to the tasks; a task runs the scaled forward and backward recursion over packed batches of
texts of like length and gives back expected counts: of starts and transitions, and of emissions per word. These are
summed by Spark and are the next model. Every round runs over all training texts; the seeded start breaks the symmetry of
the states. Rounds end when the mean log10 probability of a token has stopped to rise by ``gain``, and after ``rounds`` at
the latest. A score is the logarithm of the text's probability by the scaled forward recursion: no pruning, no window.

Only the model goes through the driver: states x (frequent + 2) numbers, whatever the size of the corpus. The counts of
rare words stay distributed and meet the documents in a join of (document, rare words) rows.

A null text is an empty one: a single end. Texts with repeated ids are scored one by one. With no training text there
are no counts, and every token has the probability of an unseen one.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import chain, repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from ..session import reliable_checkpoint, written
from .common import small_batches

END, RARE = 0, 1
SMOOTHING = 0.1
BATCH_TOKENS = 600_000
HELD_TOKENS = 4_000_000
HELD_WORDS = 2_000_000  # words are objects, numbers are not
GAIN = 0.001
SUM_ROWS = 8_192


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


@dataclass
class Hmm:
    """Start, transition and emission probabilities; columns of ``emit`` are END, RARE, then the frequent words."""

    words: dict[bytes, int]
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray

    def numbers(self, words: list[bytes]) -> list[int]:
        return [*map(self.words.get, words, repeat(RARE)), END]


class Packed:
    """Sequences side by side, longest first, so that step t works on a prefix of them at once."""

    def __init__(self, flat: np.ndarray, lengths: np.ndarray):
        """``flat`` has the numbers of all sequences one after another; each sequence has at least its end."""
        self.order = np.argsort(-lengths, kind="stable")
        place = np.empty(len(lengths), np.int64)
        place[self.order] = np.arange(len(lengths))
        begins = np.cumsum(lengths) - lengths
        steps = np.arange(lengths.max(initial=0))
        self.active = np.searchsorted(-lengths[self.order], -steps, side="left")  # sequences longer than t
        self.offsets = np.append(0, np.cumsum(self.active))
        column = np.arange(len(flat)) - np.repeat(begins, lengths)
        self.tokens = np.empty(len(flat), np.int32)
        self.tokens[self.offsets[column] + np.repeat(place, lengths)] = flat
        # a long text has many steps of few sequences, so a step is little more than a few small matrix products
        self.steps = list(zip(self.offsets.tolist(), self.offsets[1:].tolist()))

    def forward(self, model: Hmm, kind: type = np.float64) -> tuple[np.ndarray, np.ndarray]:
        """Scaled forward variables and the scales; the scales of a sequence multiply to its probability."""
        alpha = np.ascontiguousarray(model.emit.T, dtype=kind)[self.tokens]
        start, move, ones = model.start.astype(kind), model.move.astype(kind), np.ones(len(model.start), kind)
        scales = np.empty(len(self.tokens), kind)
        into = np.empty((len(self.order), len(start)), kind)
        into[:] = start
        before = None
        for low, high in self.steps:
            here, coming = alpha[low:high], into[: high - low]
            if before is not None:
                np.dot(before[: high - low], move, coming)
            here *= coming
            np.dot(here, ones, scales[low:high])
            here /= scales[low:high, None]
            before = here
        return alpha, scales

    def log_probabilities(self, model: Hmm) -> np.ndarray:
        """log10 probability of each sequence, in the order they were given."""
        _, scales = self.forward(model)
        row = np.arange(len(scales)) - np.repeat(self.offsets[:-1], self.active)
        sums = np.bincount(row, weights=np.log10(scales), minlength=len(self.order))
        result = np.empty(len(sums))
        result[self.order] = sums
        return result

    def expected(self, model: Hmm, counts: dict[str, np.ndarray]) -> None:
        """Add the expected starts, moves and emissions of the batch, and its log10 probability, to ``counts``."""
        alpha, scales = self.forward(model, np.float32)
        counts["gained"] += (np.log10(scales).sum(dtype=float), len(scales))
        emit = np.ascontiguousarray(model.emit.T, dtype=np.float32)[self.tokens]
        emit /= scales[:, None]
        back_move, moved = np.ascontiguousarray(model.move.T, dtype=np.float32), np.zeros_like(model.move)
        beta = np.ones((len(self.order), len(model.start)), np.float32)  # stays one for a sequence that ends at the step
        for low, high in reversed(self.steps[1:]):
            ahead = emit[low:high]
            ahead *= beta[: high - low]
            np.dot(ahead, back_move, beta[: high - low])
        # ``emit`` now holds what follows each place of a later step; the place before it is a step earlier in the same row
        first = self.steps[0][1] if self.steps else 0
        earlier = np.arange(first, len(self.tokens)) - np.repeat(self.active[:-1], self.active[1:])
        for low in range(0, len(earlier), SUM_ROWS):  # in parts, whose sums are added up in double precision
            places, ahead = earlier[low : low + SUM_ROWS], emit[first + low : first + low + SUM_ROWS]
            here = alpha[places]
            moved += here.T @ ahead
            alpha[places] = here * (ahead @ back_move)  # from here on the probability of each state at the place
        counts["start"] += alpha[: self.active[0]].sum(axis=0, dtype=float)
        counts["move"] += moved * model.move
        width = model.emit.shape[1]
        for state in range(len(model.start)):
            counts["emit"][state] += np.bincount(self.tokens, weights=alpha[:, state], minlength=width)


def batches_of(items: Iterator, size: Callable = len, limit: int = BATCH_TOKENS, held: int = HELD_TOKENS) -> Iterator[list]:
    """Lists of items of about ``limit`` tokens, which bounds the memory of a task; a longer text is a list of its own.

    Items wait until ``held`` tokens are there and go by length, so that a batch takes few steps beyond its shortest text.
    """
    waiting, total = [], 0

    def cut() -> Iterator[list]:
        waiting.sort(key=size, reverse=True)
        part, tokens = [], 0
        for item in waiting:
            if part and tokens + size(item) > limit:
                yield part
                part, tokens = [], 0
            part.append(item)
            tokens += size(item)
        if part:
            yield part
        waiting.clear()

    for item in items:
        waiting.append(item)
        total += size(item)
        if total >= held:
            yield from cut()
            total = 0
    yield from cut()


def numbered_texts(texts: DataFrame, words: dict[bytes, int]) -> DataFrame:
    """The numbers of the words of each text and its end, as little-endian bytes, written to the shared folder."""
    shared = texts.sparkSession.sparkContext.broadcast(words)
    kind = number_type(len(words))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        for batch in small_batches(batches):
            rows = []
            for text in batch.column(0).to_pylist():
                found = words_of(text)
                rows.append(np.fromiter((*map(known.get, found, repeat(RARE)), END), kind, len(found) + 1).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary())], names=["numbers"])

    return written(texts.mapInArrow(run, "numbers binary"))


def number_type(words: int) -> np.dtype:
    return np.dtype("<u2" if words + 2 <= 1 << 16 else "<u4")


def word_counts(texts: DataFrame, flush: int = 400_000) -> DataFrame:
    """(word, count) over all texts, one end per text as the empty word; tasks sum up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], ["word", "count"])

        for batch in small_batches(batches):
            for text in batch.column(0).to_pylist():
                counts.update(words_of(text))
                counts[b""] += 1
                if len(counts) > flush:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return texts.mapInArrow(run, "word binary, count long").groupBy("word").agg(F.sum("count").alias("count"))


def first_model(words: list[bytes], counts: np.ndarray, states: int, seed: int) -> Hmm:
    """Sticky states with the corpus' frequencies, each bent by a seeded factor per word."""
    rng = np.random.default_rng(seed)
    emit = counts[None, :] * rng.uniform(0.5, 1.5, (states, len(counts)))
    move = np.full((states, states), 0.1 / max(1, states - 1)) if states > 1 else np.ones((1, 1))
    if states > 1:
        np.fill_diagonal(move, 0.9)
    emit /= emit.sum(axis=1, keepdims=True)
    return Hmm({word: i + 2 for i, word in enumerate(words)}, np.full(states, 1 / states), move, emit)


def baum_welch_round(texts: DataFrame, model: Hmm, background: np.ndarray) -> tuple[Hmm, float]:
    """One round over numbered texts: the next model, and the mean log10 probability of a token under the one before.

    Expected counts are summed per task, then by word, then normalised.
    """
    shared = texts.sparkSession.sparkContext.broadcast(model)
    states, width = model.emit.shape
    kind = number_type(width - 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        counts = {"start": np.zeros(states), "move": np.zeros((states, states)), "emit": np.zeros((states, width)), "gained": np.zeros(2)}
        rows = (row for batch in batches for row in batch.column(0).to_pylist())
        for part in batches_of(rows, lambda row: len(row) // kind.itemsize):
            lengths = np.array([len(row) // kind.itemsize for row in part])
            Packed(np.frombuffer(b"".join(part), kind), lengths).expected(fitted, counts)
        used = np.flatnonzero(counts["emit"].any(axis=0))
        gained = np.resize(counts["gained"], states) if states > 1 else counts["gained"][:1]
        rows = [gained, counts["start"], *counts["move"], *counts["emit"][:, used].T]
        names = [-2 - states, -1 - states, *range(-states, 0), *used.tolist()]
        yield pa.RecordBatch.from_pydict({"item": pa.array(names, pa.int64()), **{f"s{i}": np.array([row[i] for row in rows]) for i in range(states)}})

    columns = [f"s{i}" for i in range(states)]
    parts = texts.mapInArrow(run, "item long, " + ", ".join(f"{name} double" for name in columns))
    summed = parts.groupBy("item").agg(*[F.sum(name).alias(name) for name in columns]).toPandas().set_index("item")
    table = np.zeros((width + states + 2, states))
    table[summed.index.to_numpy() + states + 2] = summed[columns].to_numpy()
    gained, table = table[0], table[1:]
    start, move, emit = table[0] + SMOOTHING, table[1 : states + 1] + SMOOTHING, table[states + 1 :].T + SMOOTHING * background
    tokens = table[states + 1 :].sum()
    better = Hmm(model.words, start / start.sum(), move / move.sum(axis=1, keepdims=True), emit / emit.sum(axis=1, keepdims=True))
    return better, float(gained[0] / tokens) if tokens else 0.0


@dataclass
class LanguageModel:
    """The hidden Markov model with the corpus' word counts: of the commonest words here, of all words in a table."""

    hmm: Hmm
    counts: dict[bytes, int]
    table: DataFrame
    tokens: int
    base_mass: float
    class_mass: float
    reached: list[float]  # mean log10 probability of a training token before each round

    def base(self, count: Column) -> Column:
        """log10 of the smoothed share of a word in all training tokens, with one further type for unseen words."""
        return F.log10((count + SMOOTHING) / self.base_mass)

    def in_class(self, count: Column) -> Column:
        """log10 of a rare word's share of its class, in which unseen words are one more type."""
        return F.log10((count + SMOOTHING) / self.class_mass)


def fit_hmm(
    docs: DataFrame,
    trained: Column,
    text: str = "text",
    states: int = 8,
    frequent: int = 32_768,
    known: int = 131_072,
    rounds: int = 10,
    gain: float = GAIN,
    seed: int = 3,
) -> LanguageModel:
    """Train on the rows where ``trained`` holds, in at most ``rounds`` rounds over all of them.

    ``frequent`` words have own emissions, the counts of ``known`` words travel with the model.
    """
    texts = docs.where(trained).select(F.col(text).cast("string").alias("text"))
    counted = reliable_checkpoint(word_counts(texts))
    whole = counted.agg(F.sum("count").alias("tokens"), F.count(F.lit(1)).alias("types")).first()
    tokens, types = whole["tokens"] or 0, whole["types"]
    ends = counted.where("word = X''").first()
    top = commonest(counted.where("word <> X''"), known)
    words = [word for word, _ in top[:frequent]]
    counts = dict(top) | {b"": ends["count"] if ends else 0}
    rare = tokens - counts[b""] - sum(counts[word] for word in words)
    frequencies = np.array([counts[b""], rare + SMOOTHING, *[counts[word] for word in words]]) + SMOOTHING
    model = first_model(words, frequencies, states, seed)
    background = frequencies / frequencies.sum()
    numbers, reached = numbered_texts(texts, model.words), []
    for _ in range(rounds):
        model, mean = baum_welch_round(numbers, model, background)
        reached.append(mean)
        if len(reached) > 2 and mean - reached[-2] < gain:  # the first rounds only break the symmetry
            break
    rare_types = types - len(words) - bool(ends)
    return LanguageModel(
        model, counts, counted, tokens, tokens + SMOOTHING * (types + 1), rare + SMOOTHING * (rare_types + 1), reached
    )


def commonest(counted: DataFrame, size: int) -> list[tuple[bytes, int]]:
    """At most ``size`` words by falling count; a histogram of the counts tells where to stop, and ties go by the word."""
    histogram = counted.groupBy("count").agg(F.count(F.lit(1)).alias("words")).orderBy(F.desc("count"))
    least, room = 2**62, size
    for row in histogram.toLocalIterator():
        if room <= 0:
            break
        least, room = row["count"], room - row["words"]
    # every count above the last one taken fits as a whole
    surely = counted.where(F.col("count") > least).collect()
    ties = counted.where(F.col("count") == least).orderBy(F.xxhash64("word"), "word").limit(max(0, size - len(surely))).collect()
    return sorted(((bytes(row["word"]), row["count"]) for row in surely + ties), key=lambda item: (-item[1], item[0]))


FIELDS = ["n_tokens", "n_known", "base_score", "score"]


def score_texts(docs: DataFrame, model: LanguageModel, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``n_tokens``, ``n_known``, ``base_score`` and ``score`` of every document.

    One pass over the texts gives a row per document for all that the model holds, and a row for each rare word in it.
    The rare words' counts are joined to those, and a sum per document puts the parts together. A document's own row
    carries a word that no text can hold, different for each, so these rows spread evenly over the join.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.hmm, model.counts, model.base_mass, model.class_mass))
    numbered = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    numbered = numbered.withColumn("row_id", F.monotonically_increasing_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hmm, counts, base_mass, class_mass = shared.value
        shift = float(np.log10(base_mass / class_mass))  # from a word's base to its share of the rare class
        bases = {word: float(np.log10((n + SMOOTHING) / base_mass)) for word, n in counts.items()}
        # per word: its base, and what its share of the rare class adds to the score
        known = {word: (base, 0.0 if not word or word in hmm.words else base + shift) for word, base in bases.items()}
        no_end = not counts[b""]
        parts = (zip(*[batch.column(name).to_pylist() for name in ("key", "row_id", "text")], strict=True) for batch in small_batches(batches))
        rows = ((name, row_id, words_of(value)) for part in parts for name, row_id, value in part)
        for group in batches_of(rows, size=lambda row: len(row[2]) + 1, held=HELD_WORDS):
            lengths = np.array([len(words) + 1 for _, _, words in group])
            numbers = chain.from_iterable(hmm.numbers(words) for _, _, words in group)
            scores = Packed(np.fromiter(numbers, np.int32, lengths.sum()), lengths).log_probabilities(hmm)
            own: dict[str, list] = {name: [] for name in FIELDS}
            rare: tuple[list, list, list] = ([], [], [])
            for (_, row_id, words), score in zip(group, scores.tolist(), strict=True):
                tally = Counter(words)
                seen, base = len(words) + 1 - no_end, known[b""][0]
                for word, times in tally.items():
                    if hit := known.get(word):
                        base += times * hit[0]
                        score += times * hit[1]
                    else:
                        seen -= times
                        rare[0].append(row_id)
                        rare[1].append(word)
                        rare[2].append(times)
                for name, value in zip(FIELDS, (len(words) + 1, seen, base, score), strict=True):
                    own[name].append(value)
            marks = [b" %d" % row_id for _, row_id, _ in group]
            yield rows_of(key=[name for name, _, _ in group], row_id=[at for _, at, _ in group], word=marks, times=[0] * len(group), **own)
            yield rows_of(row_id=rare[0], word=rare[1], times=rare[2])

    def rows_of(**columns: list) -> pa.RecordBatch:
        size = len(columns["row_id"])
        return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(size, f.type) for f in kinds], schema=kinds)

    key_type = numbered.schema["key"].dataType
    schema = (
        f"row_id long, key {key_type.simpleString()}, word binary, times long, "
        "n_tokens long, n_known long, base_score double, score double"
    )
    kinds = pa.schema(
        [("row_id", pa.int64()), ("key", to_arrow_type(key_type)), ("word", pa.binary()), ("times", pa.int64())]
        + [("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())]
    )
    parts = numbered.mapInArrow(run, schema).join(model.table, "word", "left")
    seen, times = F.coalesce("count", F.lit(0)), F.col("times")
    full = parts.select(  # a document's own row brings its values, the row of a rare word what that word adds
        "row_id",
        "key",
        "n_tokens",
        F.coalesce("n_known", F.when(seen > 0, times), F.lit(0)).alias("n_known"),
        F.coalesce("base_score", times * model.base(seen)).alias("base_score"),
        F.coalesce("score", times * model.in_class(seen)).alias("score"),
    )
    return full.groupBy("row_id").agg(
        F.max("key").alias("key"),
        F.sum("n_tokens").alias("n_tokens"),
        F.sum("n_known").alias("n_known"),
        F.sum("base_score").alias("base_score"),
        F.sum("score").alias("score"),
    ).drop("row_id")
