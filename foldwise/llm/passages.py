"""Bytes of passages that an earlier document holds: ranks of places by prefix doubling, on anchored places.

A window is a string of ``length`` bytes (50) inside one text. A byte goes when a window over it also starts in a
document with a smaller id. Prefix doubling ranks the places of all texts by their first 1, 2, 4, ... bytes: the rank for
twice the size is that of the pair (rank here, rank one size further), and a place whose rank is unique is done.

All places times all rounds through a shuffle would take many times the input's disk, so two things differ from the
textbook form. Ranks are 64-bit fingerprints of the pairs, equal for equal strings in every task, so the first rounds (to
16 bytes) need no shuffle. And only anchors are shuffled: of the ``length - 15`` places in a window at which 16 bytes
start inside it, the one with the smallest mixed rank. Equal windows have the same anchor, at the same distance, so each
window belongs to one anchor, and an anchor's windows follow one another: their bytes are its context.

1. Spark sorts (rank, rank of the context, document) of all anchors. Anchors with a unique rank are done. A context that
   a smaller document has as well is covered. Of the others the anchors of a rank with several contexts stay.
2. Their contexts, read from the texts, are sorted by (rank, document) and compared window by window, on the bytes.

Step 1 decides on 128 bits of fingerprint, step 2 on the bytes. Equal contexts in one task are one row of the shuffle, so
a passage in a third of all documents is about one row per task and anchor. The sort of step 1 streams with one row of
memory; in step 2 a rank with more than ``crowded`` contexts goes another way: its windows are rows, grouped by Spark.

The id must be an integer. A null id counts as larger than any other, equal ids as neither smaller nor larger. Null,
empty and short texts lose nothing; repeated rows get the same result; an empty table gives an empty one. Kept columns
travel in a struct. A very long text is handled whole, in memory of some hundred bytes for each of its bytes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.bittable import bit_table, passes, table_bits
from ..session import release_shuffles, reliable_checkpoint, written
from .common import annotate, packed

LENGTH = 50
CHUNK = 1 << 20
ROWS = 1 << 20
CROWDED = 20_000
NO_ID = 2**63 - 1
PLACE, TIE, WIDTH = 31, 18, 6  # bits of an offset in a text, of the digest that tells equal ids apart, of a width
ONE, TWO = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def mixed(values: np.ndarray) -> np.ndarray:
    values = (values ^ (values >> np.uint64(32))) * TWO
    return values ^ (values >> np.uint64(29))


BYTES = mixed((np.arange(256, dtype=np.uint64) + np.uint64(1)) * ONE)


def joined(ranks: np.ndarray, shift: int) -> np.ndarray:
    """The rank of each pair of places ``shift`` apart."""
    return mixed(ranks[:-shift] * ONE + ranks[shift:])


def anchor_size(length: int) -> int:
    """The power of two next below a third of the length."""
    return 1 << max(0, (length // 3).bit_length() - 1)


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(rank, rank of the context, text, first window, last window, anchor) of every anchor; places are within the text."""
    sizes = np.array([len(text) for text in texts])
    begins = np.cumsum(sizes) - sizes
    ranks, size = BYTES[np.frombuffer(b"".join(texts), np.uint8)], 1
    short = anchor_size(length)
    while size < short:
        ranks, size = joined(ranks, size), 2 * size
    order = (mixed(ranks) >> np.uint64(PLACE) << np.uint64(PLACE)) | np.arange(len(ranks), dtype=np.uint64)
    whole = ranks
    while 2 * size <= length:
        whole, size = joined(whole, size), 2 * size
    if size < length:
        whole = joined(whole, length - size)
    span, reached = length - short + 1, 1
    while reached < span:  # the smallest of ``reached`` places from each on
        step = min(reached, span - reached)
        order, reached = np.minimum(order[:-step], order[step:]), reached + step
    windows = np.maximum(sizes - length + 1, 0)
    starts = np.arange(windows.sum()) + np.repeat(begins - (np.cumsum(windows) - windows), windows)
    at = (order[starts] & np.uint64((1 << PLACE) - 1)).astype(np.int64)
    edges = np.flatnonzero(at[1:] != at[:-1]) + 1
    low, high = np.append(0, edges), np.append(edges, len(at)) - 1
    first, last, at = starts[low], starts[high], at[low]
    shape = ((at - first) << WIDTH | (last - first)).astype(np.uint64)
    context = mixed(mixed(whole[first] * ONE + whole[last]) * ONE + shape)
    text = np.searchsorted(begins, first, side="right") - 1  # empty texts before it begin at the same place
    base = begins[text]
    return ranks[at].view(np.int64), context.view(np.int64), text, first - base, last - base, at - base


def one_row_each(rank: np.ndarray, context: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """True for rows whose context a smaller document among these rows has."""
    order = np.lexsort((doc, context, rank))
    new = np.append(True, (rank[order][1:] != rank[order][:-1]) | (context[order][1:] != context[order][:-1]))
    first = order[np.maximum.accumulate(np.where(new, np.arange(len(order)), 0))]
    later = np.zeros(len(doc), bool)
    later[order] = doc[order] > doc[first]
    return later


ANCHOR_SCHEMA = "rank long, context long, doc long, at long"


def anchor_rows(docs: DataFrame, length: int) -> DataFrame:
    """(rank, context, doc, at) of all anchors; ``at`` packs place, tie, windows and distance. Negative: spans to cover.

    Rows of one task with equal contexts are one row, of the smallest document, and spans of the others.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        texts: list[bytes] = []
        docs: list[int] = []
        ties: list[int] = []

        def search() -> None:
            if not texts:
                return
            rank, context, text, first, last, at = anchors(texts, length)
            doc, tie = np.array(docs, np.int64)[text], np.array(ties, np.int64)[text]
            place = (first << TIE | tie) << 2 * WIDTH | (last - first) << WIDTH | (at - first)
            held.append((rank, context, doc, place))
            for values in (texts, docs, ties):
                values.clear()

        def out() -> pa.RecordBatch:
            rank, context, doc, at = map(np.concatenate, zip(*held))
            held.clear()
            later = one_row_each(rank, context, doc)
            # spans of later rows that touch are one; the length of a span takes the place of the context
            gone, name = at[later], doc[later]
            start, tie, width, _ = unpacked(gone)
            stop = start + width + length
            new = np.append(True, (name[1:] != name[:-1]) | (tie[1:] != tie[:-1]) | (start[1:] > stop[:-1]) | (start[1:] < start[:-1]))
            low, high = np.flatnonzero(new), np.append(np.flatnonzero(new)[1:], len(new)) - 1
            if not len(gone):
                low = high = np.empty(0, np.int64)
            spread = mixed(name[low].view(np.uint64) + ONE * start[low].view(np.uint64)).view(np.int64)
            columns = [
                np.concatenate([rank[~later], spread]),
                np.concatenate([context[~later], stop[high] - start[low]]),
                np.concatenate([doc[~later], name[low]]),
                np.concatenate([at[~later], ~gone[low]]),
            ]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["rank", "context", "doc", "at"])

        waiting = 0
        for batch in batches:
            for text, doc, tie in zip(*[batch.column(name).to_pylist() for name in ("text", "doc", "tie")], strict=True):
                if text is None or len(text) < length:
                    continue
                texts.append(text)
                docs.append(doc)
                ties.append(tie)
                waiting += len(text)
                if waiting >= CHUNK:
                    search()
                    waiting = 0
            if sum(len(part[0]) for part in held) >= ROWS:
                yield out()
        search()
        if held:
            yield out()

    return docs.select("text", "doc", "tie").mapInArrow(run, ANCHOR_SCHEMA)


def unpacked(at: np.ndarray) -> tuple[np.ndarray, ...]:
    """Place of the first window, tie, windows after the first, distance of the anchor."""
    low = (1 << WIDTH) - 1
    return at >> TIE + 2 * WIDTH, at >> 2 * WIDTH & (1 << TIE) - 1, at >> WIDTH & low, at & low


class Sweep:
    """Rows sorted by (rank, context, doc): spans that are covered, and anchors that have to be looked at by window."""

    SCHEMA = "rank long, doc long, tie int, start long, stop long"

    def __init__(self, length: int):
        self.length = length
        self.rows = tuple(np.empty(0, np.int64) for _ in range(4))
        self.done = np.empty(0, bool)
        self.several = False  # whether the first rank held has had other contexts before

    def __call__(self, columns: list[np.ndarray]) -> pa.RecordBatch:
        spans = columns[3] < 0
        at = ~columns[3][spans]
        start, tie, _, _ = unpacked(at)
        made = [(np.zeros(len(at), bool), columns[0][spans], columns[2][spans], tie, start, start + columns[1][spans])]
        rank, context, doc, at = (np.concatenate([a, b[~spans]]) for a, b in zip(self.rows, columns, strict=True))
        done = np.append(self.done, np.zeros(len(rank) - len(self.done), bool))
        if len(rank):
            new_rank = np.append(True, rank[1:] != rank[:-1])
            new = new_rank | np.append(True, context[1:] != context[:-1])
            group = np.cumsum(new_rank) - 1
            contexts = np.bincount(group, weights=new)
            contexts[0] += self.several
            first = np.maximum.accumulate(np.where(new, np.arange(len(rank)), 0))
            covered = doc > doc[first]
            wanted = ~covered & (contexts[group] > 1)
            chosen = (covered | wanted) & ~done
            start, tie, width, _ = unpacked(at[chosen])
            made.append((wanted[chosen], rank[chosen], doc[chosen], tie, start, start + width + self.length))
            self.several = bool(contexts[-1] > 1)
            if self.several:
                keep, mark = first[-1:], True
            else:
                keep, mark = np.flatnonzero((group == group[-1]) & ~covered), False
            self.rows = tuple(values[keep] for values in (rank, context, doc, at))
            self.done = np.full(len(keep), mark)
        open_, rank, doc, tie, start, stop = map(np.concatenate, zip(*made, strict=True))
        arrays = [pa.array(rank, pa.int64(), mask=~open_), pa.array(doc, pa.int64()), pa.array(tie.astype(np.int32), pa.int32())]
        arrays += [pa.array(start, pa.int64()), pa.array(stop, pa.int64())]
        return pa.RecordBatch.from_arrays(arrays, ["rank", "doc", "tie", "start", "stop"])


def swept(rows: DataFrame, length: int) -> DataFrame:
    """(rank, doc, tie, start, stop): spans that are covered (null rank), and contexts whose windows are still open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sweep = Sweep(length)
        for batch in batches:
            if batch.num_rows:
                yield sweep([column.to_numpy(zero_copy_only=False) for column in batch.columns])

    dealt = rows.repartition("rank").sortWithinPartitions("rank", "context", "doc")
    return dealt.mapInArrow(run, Sweep.SCHEMA)


def window_spans(contexts: DataFrame, length: int) -> DataFrame:
    """Covered spans (doc, tie, start, stop) of (rank, doc, tie, start, part), comparing windows within each rank."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, seen = None, {}
        for batch in batches:
            found: list[tuple] = []
            for rank, doc, tie, start, part in zip(*[column.to_pylist() for column in batch.columns], strict=True):
                if rank != current:
                    current, seen = rank, {}
                know = seen.setdefault
                begin = None
                for i in range(len(part) - length + 1):
                    if know(part[i : i + length], doc) < doc:
                        begin = i if begin is None else begin
                        end = i
                    elif begin is not None and i - end >= length:
                        found.append((doc, tie, start + begin, start + end + length))
                        begin = None
                if begin is not None:
                    found.append((doc, tie, start + begin, start + end + length))
            columns = list(zip(*found)) if found else [[]] * 4
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64()]
            arrays = [pa.array(values, kind) for values, kind in zip(columns, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, ["doc", "tie", "start", "stop"])

    dealt = contexts.select("rank", "doc", "tie", "start", "part").repartition("rank").sortWithinPartitions("rank", "doc")
    return dealt.mapInArrow(run, "doc long, tie int, start long, stop long")


def crowded_spans(contexts: DataFrame, length: int) -> DataFrame:
    """The same for ranks with very many contexts: each window is a row, and Spark finds its smallest document."""
    place = F.explode(F.sequence(F.lit(0), F.length("part") - length)).alias("i")
    rows = contexts.select("doc", "tie", "start", "part", place)
    rows = rows.select("doc", "tie", (F.col("start") + F.col("i")).alias("start"), F.substring("part", F.col("i") + 1, F.lit(length)).alias("window"))
    least = rows.groupBy("window").agg(F.min("doc").alias("least"))
    later = rows.join(least, "window").where("least < doc")
    return later.select("doc", "tie", "start", (F.col("start") + length).alias("stop"))


def among(rows: DataFrame, names: DataFrame, wanted: bool) -> DataFrame:
    """The rows whose (doc, tie) may be among ``names``, or those for which it is not: only the first have to be shuffled."""
    digests = names.select("doc", "tie").distinct().select(F.xxhash64("doc", "tie").alias("digest"))
    bits = table_bits(digests.agg(F.approx_count_distinct("digest")).first()[0])
    marked = rows.withColumn("_table", bit_table(digests, bits))
    passing = passes(F.xxhash64("doc", "tie"), F.col("_table"), bits)
    return marked.where(passing if wanted else ~passing).drop("_table")


SPAN = T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())])
FIELDS = [
    T.StructField("n_bytes", T.LongType()),
    T.StructField("spans", T.ArrayType(SPAN)),
    T.StructField("kept", T.BinaryType()),
]


def without(text: bytes, spans: list[tuple[int, int]]) -> tuple[list[tuple[int, int]], bytes]:
    """Maximal removed runs and the bytes that are left."""
    runs: list[list[int]] = []
    for start, stop in sorted(spans):
        if runs and start <= runs[-1][1]:
            runs[-1][1] = max(stop, runs[-1][1])
        else:
            runs.append([start, stop])
    ends = [0, *[stop for _, stop in runs]]
    starts = [*[start for start, _ in runs], len(text)]
    return [tuple(run) for run in runs], b"".join(text[a:b] for a, b in zip(ends, starts, strict=True))


def remove_passages(
    docs: DataFrame, keep: list[str], key: str = "doc_id", text: str = "text", length: int = LENGTH, crowded: int = CROWDED
) -> DataFrame:
    """Documents as ``row``, with ``n_bytes``, the removed ``spans`` (start and stop in bytes) and the ``kept`` bytes."""
    if not 3 <= length < 1 << WIDTH + 1 or length - anchor_size(length) >= 1 << WIDTH:
        raise ValueError(f"length {length} is outside what an anchor's place can hold")
    content = F.col(text).cast("string")
    place = [
        F.coalesce(F.col(key).cast("long"), F.lit(NO_ID)).alias("doc"),
        F.pmod(F.xxhash64(content), F.lit(1 << TIE)).cast("int").alias("tie"),
        content.cast("binary").alias("text"),
    ]
    places = docs.select(*place)
    spark = docs.sparkSession
    found = written(swept(anchor_rows(places, length), length))
    release_shuffles(spark)  # those of all anchors
    opened = found.where("rank is not null")
    hot = opened.groupBy("rank").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > crowded).select("rank")
    part = F.substring("text", (F.col("start") + 1).cast("int"), (F.col("stop") - F.col("start")).cast("int")).alias("part")
    read = among(places, opened, wanted=True).select("doc", "tie", "text")
    contexts = opened.join(read, ["doc", "tie"]).select("rank", "doc", "tie", "start", part)
    spans = found.where("rank is null").select("doc", "tie", "start", "stop")
    if hot.isEmpty():
        spans = spans.unionAll(window_spans(contexts, length))
    else:
        hot = reliable_checkpoint(hot)
        spans = spans.unionAll(window_spans(contexts.join(hot, "rank", "left_anti"), length))
        spans = spans.unionAll(crowded_spans(contexts.join(hot, "rank", "left_semi"), length))
    grouped = written(spans.groupBy("doc", "tie").agg(F.collect_list(F.struct("start", "stop")).alias("spans")))
    release_shuffles(spark)
    whole = docs.select(packed(docs, keep), *place)
    none = F.lit(None).cast(grouped.schema["spans"].dataType).alias("spans")
    joined_ = among(whole, grouped, wanted=True).join(grouped, ["doc", "tie"], "left").select("row", "text", "spans")
    joined_ = joined_.unionAll(among(whole, grouped, wanted=False).select("row", "text", none))

    def start():
        def process(batch):
            made = {"n_bytes": [], "spans": [], "kept": []}
            for value, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                value = value or b""
                runs, left = without(value, [(span["start"], span["stop"]) for span in spans or []])
                made["n_bytes"].append(len(value))
                made["spans"].append(runs)
                made["kept"].append(left)
            return made

        return process

    inputs = {"text": F.col("text"), "spans": F.col("spans")}
    return annotate(joined_, ["row"], inputs, start, FIELDS).select("row.row", "n_bytes", "spans", "kept")
