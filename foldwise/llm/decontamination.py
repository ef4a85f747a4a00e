"""Benchmark passages inside documents, found by Wu-Manber search over words.

Every window of 13 consecutive words of an item is a pattern; an item with fewer words is one pattern. The
search slides over a document's words: a table over blocks of two words says how far the position may jump
without missing a pattern, a block that ends some pattern opens a bucket, and the strings in it are compared
with the document word by word.

Items are read in blocks of bounded size, one broadcast and one pass over the documents for each; nothing is
shuffled, so neither a hot source nor a passage that many documents share is gathered anywhere.

A null or empty document has no words and no hit. An item without words has no pattern, a null ``item_id``
counts as the empty text, repeated items count once, and an empty items table leaves every document clean.
Documents keep their number, order of columns and repeats.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import annotate, packed

WINDOW = 13
BLOCK_BYTES = 1 << 20
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_hit", T.LongType()),
    T.StructField("item_ids", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.ArrayType(T.LongType()))),
]


def words_of(text: str | None) -> list[bytes]:
    """Runs of digits, lower-cased A-Z and everything beyond ASCII, as UTF-8."""
    return WORD.findall(text.encode("utf-8", "surrogatepass").lower()) if text else []


class WuManber:
    """Search for many word sequences at once; ``patterns`` maps a sequence to what is known of it."""

    def __init__(self, patterns: dict[tuple, list[str]]):
        self.patterns = patterns
        self.length = min(map(len, patterns))
        self.block = min(2, self.length)
        self.jump = self.length - self.block + 1
        self.shift: dict[tuple, int] = {}
        self.bucket: dict[tuple, dict[tuple, list[tuple]]] = {}
        for pattern in patterns:
            for end in range(self.block, self.length + 1):
                piece = pattern[end - self.block : end]
                self.shift[piece] = min(self.shift.get(piece, self.jump), self.length - end)
            head = pattern[: self.length]
            self.bucket.setdefault(head[-self.block :], {}).setdefault(head, []).append(pattern)

    def occurrences(self, words: list[bytes]) -> Iterator[tuple[int, tuple]]:
        """(start, pattern) of every occurrence, overlapping ones included, in order of the start."""
        end, block, shift, jump = self.length, self.block, self.shift, self.jump
        while end <= len(words):
            piece = tuple(words[end - block : end])
            step = shift.get(piece, jump)
            if step:
                end += step
                continue
            start = end - self.length
            for pattern in self.bucket[piece].get(tuple(words[start:end]), ()):
                if len(pattern) == self.length or tuple(words[start : start + len(pattern)]) == pattern:
                    yield start, pattern
            end += 1


def item_patterns(items: list[tuple[str, str]], window: int) -> dict[tuple, list[str]]:
    found: dict[tuple, set[str]] = {}
    for name, text in items:
        words = words_of(text)
        for start in range(max(1, len(words) - window + 1) if words else 0):
            found.setdefault(tuple(words[start : start + window]), set()).add(name)
    return {pattern: sorted(names) for pattern, names in found.items()}


def machines(patterns: dict[tuple, list[str]], window: int) -> list[WuManber]:
    """Whole windows and shorter items apart, since the shortest pattern limits every jump."""
    groups = [{p: n for p, n in patterns.items() if (len(p) == window) == whole} for whole in (True, False)]
    return [WuManber(group) for group in groups if group]


def scan(words: list[bytes], searches: list[WuManber]) -> tuple[set[str], list[list[int]]]:
    """Items found, and the hit words as sorted, disjoint [start, end) spans."""
    items: set[str] = set()
    found = []
    for search in searches:
        for start, pattern in search.occurrences(words):
            items.update(search.patterns[pattern])
            found.append([start, start + len(pattern)])
    return items, joined(found)


def joined(spans: list[list[int]]) -> list[list[int]]:
    merged: list[list[int]] = []
    for start, end in sorted(spans):
        if merged and start <= merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], end)
        else:
            merged.append([start, end])
    return merged


def find_passages(
    docs: DataFrame,
    items: DataFrame,
    keep: list[str],
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Documents as ``row`` (the kept columns), with ``n_words``, ``n_hit``, ``item_ids`` and the hit ``spans`` of words.

    ``spans`` are sorted, disjoint [start, end) word positions, so a caller can cut the passages out.
    """
    context = docs.sparkSession.sparkContext
    named = (
        items.select(F.coalesce(F.col(item_id).cast("string"), F.lit("")).alias("name"), F.col(item_text).alias("text"))
        .where("text is not null")
        .distinct()
    )
    blocks = max(1, -(-(named.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // block_bytes))
    found = docs.select(
        packed(docs, keep),
        F.col(text).cast("string").alias("text"),
        F.lit(None).cast("array<string>").alias("item_ids"),
        F.lit(None).cast("array<array<bigint>>").alias("spans"),
    )
    for block in range(blocks):
        members = named.where(F.pmod(F.xxhash64("name", "text"), F.lit(blocks)) == block).collect()
        shared = context.broadcast([(row["name"], row["text"]) for row in members])

        def start(shared=shared):
            searches = machines(item_patterns(shared.value, window), window)

            def process(batch):
                made = {field.name: [] for field in FIELDS}
                rows = zip(*[batch.column(name).to_pylist() for name in ("text", "item_ids", "spans")], strict=True)
                for value, names, earlier in rows:
                    words = words_of(value)
                    hit, spans = scan(words, searches)
                    spans = joined(spans + (earlier or []))
                    made["n_words"].append(len(words))
                    made["n_hit"].append(sum(end - begin for begin, end in spans))
                    made["item_ids"].append(sorted(hit.union(names or [])))
                    made["spans"].append(spans)
                return made

            return process

        inputs = {name: F.col(name) for name in ("text", "item_ids", "spans")}
        carried = ["row", "text"] if block + 1 < blocks else ["row"]
        found = annotate(found, carried, inputs, start, FIELDS)
        found = found.select(*[f"row.{name}" for name in carried], *[field.name for field in FIELDS])
    return found


def contaminated(n_words, n_hit):
    """At least one word in twenty is part of a benchmark passage."""
    return (n_hit > 0) & (n_hit * 20 >= n_words)
