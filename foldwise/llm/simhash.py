"""Near copies by SimHash fingerprints and covering locality-sensitive hashing.

A fingerprint has 64 bits, each the majority over the hashes of a text's word shingles. Two fingerprints are linked
when they differ in at most ``radius`` bits, and a group is whatever links reach.

Covering: every bit position gets a nonzero vector of radius + 1 bits, and there is a table for every nonzero vector
v of that size, whose mask holds the positions with an odd product with v. For any ``radius`` positions some v is
orthogonal to all of their vectors, so two fingerprints within the radius agree under the mask of that table: each
pair meets in some bucket, with certainty. Within a bucket a breadth-first search gives one link per fingerprint, to
the smallest of its group; pairs are never listed.

Copies are one fingerprint, however many they are. A bucket with more than ``BUCKET`` fingerprints is dealt out again
by masks that cover its free bits the same way; after three rounds at most eight bits are free, so every bucket is
bounded and no link is lost.

Texts without words have fingerprint zero and are linked like any other. Null ids are kept; a component's id is the
smallest id that is not null, and null only if it has no other. Repeated rows are in one component.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import release_shuffles, reliable_checkpoint
from .common import annotate
from .components import component_roots
from .jaccard import overlap_links

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
BUCKET = 2048
ROUNDS = 3


def fingerprint(text: str | None, shingle: int = SHINGLE, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit number."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return 0
    line = b" ".join(words)
    ends = np.cumsum([len(word) + 1 for word in words]) - 1
    starts = (ends - [len(word) for word in words]).tolist()
    ends = ends.tolist()
    size = min(shingle, len(words))
    digest = xxhash.xxh64_intdigest
    pieces = zip(starts, ends[size - 1 :])
    hashes = np.fromiter((digest(line[a:b], seed) for a, b in pieces), np.uint64, len(words) - size + 1)
    bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(bits * 2 > len(hashes), bitorder="little").view(np.int64)[0])


def covering_masks(free: list[int], radius: int = RADIUS) -> list[int]:
    """For each table the positions, among the free ones, that its key keeps."""
    vectors = 2 ** (radius + 1) - 1
    return [
        sum(1 << bit for i, bit in enumerate(free) if bin((1 + i % vectors) & table).count("1") % 2)
        for table in range(1, vectors + 1)
    ]


def table_masks(radius: int = RADIUS, rounds: int = ROUNDS) -> list[dict[int, int]]:
    """Per round the mask of each table; a table of a later round is its parent's number and a further digit."""
    levels, parents = [], {0: 0}
    for _ in range(rounds):
        level = {}
        for name, mask in parents.items():
            free = [bit for bit in range(BITS) if not mask >> bit & 1]
            for digit, part in enumerate(covering_masks(free, radius), 1):
                level[name << (radius + 1) | digit] = mask | part
        levels.append(level)
        parents = level
    return levels


def signed(mask: int) -> int:
    return mask - (1 << BITS) if mask >> (BITS - 1) else mask


def bucket_links(prints: np.ndarray, radius: int) -> tuple[list[int], list[int]]:
    """Groups within a bucket by breadth-first search: one link from each further member to the first."""
    left, links, roots = prints.view(np.uint64), [], []  # bits are counted in unsigned numbers
    while len(left) > 1:
        root, left, queue = int(left[:1].view(np.int64)[0]), left[1:], [left[0]]
        while queue and len(left):
            near = np.bitwise_count(left ^ queue.pop()) <= radius
            if near.any():
                found, left = left[near], left[~near]
                queue.extend(found)
                links.extend(found.view(np.int64).tolist())
                roots.extend([root] * len(found))
    return links, roots


def sweep_buckets(radius: int):
    """Links of sorted (table, key, print) rows; the last bucket of a batch waits for the next one."""

    def links_of(table: np.ndarray, key: np.ndarray, prints: np.ndarray) -> pa.RecordBatch:
        edges = np.flatnonzero((table[1:] != table[:-1]) | (key[1:] != key[:-1])) + 1
        starts, ends = np.append(0, edges), np.append(edges, len(key))
        u, v = [], []
        for i in np.flatnonzero(ends - starts > 1):
            links, roots = bucket_links(np.unique(prints[starts[i] : ends[i]]), radius)
            u.extend(links)
            v.extend(roots)
        return pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(name).to_numpy(zero_copy_only=False) for name in ("table", "key", "print")]
            held = columns if held is None else [np.concatenate(pair) for pair in zip(held, columns, strict=True)]
            whole = int(np.flatnonzero((held[0] == held[0][-1]) & (held[1] == held[1][-1]))[0])
            if whole:
                yield links_of(*[column[:whole] for column in held])
                held = [column[whole:] for column in held]
        if held is not None:
            yield links_of(*held)

    return run


def print_links(prints: DataFrame, radius: int = RADIUS, bucket: int = BUCKET) -> DataFrame:
    """Links (u, v) that connect exactly the distinct fingerprints (column ``print``) within the radius."""

    def opened(rows: DataFrame, level: dict[int, int], parent: Column | None) -> DataFrame:
        """Each fingerprint once per table, with its key there."""
        size = 2 ** (radius + 1)
        masks = F.array(*[F.lit(signed(level[name])) for name in sorted(level)])
        digits = F.explode(F.array(*[F.lit(digit) for digit in range(1, size)])).alias("digit")
        rows = rows.select("print", (parent if parent is not None else F.lit(0)).alias("parent"), digits)
        # tables are numbered without gaps for the array: (parent place) * (size - 1) + digit
        place = F.col("parent") * (size - 1) + F.col("digit")
        return rows.select(place.alias("table"), F.col("print").bitwiseAND(F.element_at(masks, place.cast("int"))).alias("key"), "print")

    levels = table_masks(radius)
    rows, parts = opened(prints, levels[0], None), []
    for level in levels[1:]:
        sizes = rows.groupBy("table", "key").agg(F.count(F.lit(1)).alias("rows"))
        crowded = reliable_checkpoint(sizes.where(F.col("rows") > bucket).select("table", "key"))
        if crowded.isEmpty():
            break
        parts.append(rows.join(crowded, ["table", "key"], "left_anti"))
        rows = opened(rows.join(crowded, ["table", "key"], "left_semi"), level, F.col("table") - 1)
    parts.append(rows)
    dealt = parts[0]
    for depth, part in enumerate(parts[1:], 1):
        dealt = dealt.unionByName(part.withColumn("table", F.col("table") + F.lit(depth << 20)))
    dealt = dealt.select("table", "key", "print").repartition("table", "key").sortWithinPartitions("table", "key")
    return dealt.mapInArrow(sweep_buckets(radius), "u long, v long")


def fingerprints(docs: DataFrame, keep: list[str], text: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """Documents as ``row``, with the fingerprint as a long."""

    def start():
        return lambda batch: {"print": [fingerprint(value, shingle) for value in batch.column("text").to_pylist()]}

    return annotate(docs, keep, {"text": F.col(text).cast("string")}, start, [T.StructField("print", T.LongType())])


def near_groups(
    docs: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    shingle: int = SHINGLE,
    radius: int = RADIUS,
    bucket: int = BUCKET,
    overlap: bool = False,
) -> DataFrame:
    """One row per document: ``key``, ``text_hash``, ``print``, ``root`` (a fingerprint) and ``component_id``.

    Fingerprints are computed once and written to the shared folder; links and groups work on distinct ones. With
    ``overlap`` texts with four fifths of their five-word shingles in common (``jaccard.py``) are linked as well.
    """
    source = docs.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
    source = source.withColumn("text_hash", F.xxhash64("text"))
    known = reliable_checkpoint(
        fingerprints(source, ["key", "text_hash"], shingle=shingle).select("row.key", "row.text_hash", "print")
    )
    unique = known.groupBy("print").agg(F.min("key").alias("least"))
    links = print_links(unique.select("print"), radius, bucket)
    if overlap:
        links = reliable_checkpoint(links)
        prints = known.select("text_hash", "print").distinct()
        links = links.unionByName(overlap_links(source.select("text_hash", "text"), prints, links))
        release_shuffles(docs.sparkSession)  # those of the links are not needed again
    roots = component_roots(links)
    placed = unique.join(roots, unique["print"] == roots["node"], "left").select(
        "print", "least", F.coalesce("root", "print").alias("root")
    )
    named = placed.groupBy("root").agg(F.min("least").alias("component_id"))
    groups = placed.join(named, "root").select("print", "root", "component_id")
    return known.join(groups, "print").select("key", "text_hash", "print", "root", "component_id")


def print_hex(column: Column) -> Column:
    return F.lpad(F.lower(F.hex(column)), 16, "0")


def one_of_each_group(docs: DataFrame, key: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents that stay: of each group the one with the smallest id, and of repeated rows one."""
    groups = near_groups(docs, key, text, **settings)
    first = F.min(F.struct(F.col("key").isNull(), F.col("key"), F.col("text_hash"))).alias("first")
    staying = groups.groupBy("root").agg(first).select("first.key", "first.text_hash")

    def identity(name: Column, digest: Column) -> Column:
        return F.concat_ws(":", digest, name.cast("string"))  # a null id is left out, an id is never empty

    staying = staying.select(identity(F.col("key"), F.col("text_hash")).alias("_identity"))
    columns = docs.columns
    marked = docs.select(
        F.struct(*[docs[f"`{name}`"] for name in columns]).alias("row"),
        identity(docs[key], F.xxhash64(docs[text].cast("string"))).alias("_identity"),
    )
    single = marked.groupBy("_identity").agg(F.first("row").alias("row"))
    return single.join(staying, "_identity", "left_semi").select("row.*")
