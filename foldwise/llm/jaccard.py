"""Texts whose sets of word shingles overlap by a given share (Jaccard similarity), found without loss.

A text is the set of its five-word shingles over lower-cased words (a shorter text is one shingle), each a 64-bit hash.
Two sets with a similarity of at least 4/5 have that share of either in common, so in any order of all shingles they
meet among the first ``n - ceil(4n/5) + 1`` of each (the prefix). Shingles that a sample of the texts holds often come
last in the order; that decides how many pairs meet, never which are found.

Texts that meet are compared on the whole sets. Where more than ``LISTED`` meet under a shingle, each is first compared
with the smallest one only, so a large group of near copies costs a comparison each. The crowded shingles under which
texts of different groups are left are the mixed ones. Prefixes are longer by one than they need to be, so similar sets
share two shingles there, and if no other shingle has brought them together, both are mixed: they meet again under the
first of the two. Dissimilar texts with one common shingle do not. Texts with more than ``WIDE`` mixed shingles meet all
others under each of them instead. Pairs of different groups that meet so are listed in blocks, never by one task.

A shingle's place in the order bounds the overlap: if sets of ``n`` and ``m`` have their first common one at the places
``i`` and ``j``, they share ``min(n - i, m - j)`` at most, and at the second one more than that. So a row reaches sets up to
``(5n - 9i) / 4`` only; texts of one large cluster that differ too much to be similar are mostly told apart by that.

A sweep streams through its sorted rows and holds a few of them. To verify, texts that meet much of the same are dealt into
slots of ``BLOCK``, and a text travels once to each pair of slots, not once for each pair.

Null and blank texts have no shingle and no link. Copies are one text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bittable import bit_table, passes, table_bits
from ..session import release_shuffles, reliable_checkpoint
from .common import small_batches
from .components import component_roots

SHINGLE = 5
LISTED = 8
SAMPLE = 4_096
COMMON = 65_536
CACHE = 100_000
BLOCK = 1_024
WIDE = 64
SHORT = 16
STRIP = 256
PAIRS = 1 << 17
CHECKED = 1 << 13


class Shingles:
    """Hashes of a text's shingles, sorted and each once; words are hashed once for all texts of a task."""

    def __init__(self, size: int = SHINGLE):
        self.size, self.known = size, {}

    def __call__(self, text: str | None) -> np.ndarray:
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.empty(0, np.int64)
        if len(self.known) > CACHE:
            self.known.clear()
        known = self.known
        for word in set(words).difference(known):
            known[word] = xxhash.xxh64_intdigest(word, 7)
        hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.size, len(words))
        mixed = np.full(len(words) - size + 1, size, np.uint64)
        for i in range(size):
            mixed = (mixed ^ hashes[i : len(words) - size + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        return np.unique(mixed.view(np.int64))


def prefix(tokens: np.ndarray, common: np.ndarray, rank: np.ndarray, shared: int = 1) -> np.ndarray:
    """The first shingles in the order (how often in the sample, hash), among which similar sets have ``shared`` in common."""
    if not len(tokens):
        return tokens
    often = np.zeros(len(tokens), np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, tokens), len(common) - 1)
        often = np.where(common[at] == tokens, rank[at], 0)
    return tokens[np.lexsort((tokens, often))[: len(tokens) - (4 * len(tokens) + 4) // 5 + shared]]


def similar(left: np.ndarray, right: np.ndarray) -> bool:
    both = len(np.intersect1d(left, right, assume_unique=True))
    return 9 * both >= 4 * (len(left) + len(right))


def shingle_sets(texts: DataFrame) -> DataFrame:
    """(text_hash, tokens) of every row of (text_hash, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in small_batches(batches):
            found = pa.array([shingles(text) for text in batch.column("text").to_pylist()], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("text_hash"), found], names=["text_hash", "tokens"])

    return texts.select("text_hash", "text").mapInArrow(run, "text_hash long, tokens array<long>")


def often_seen(texts: DataFrame, count: int, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray]:
    """The commonest shingles of about ``sample`` texts, sorted, with the number of those texts that hold each."""
    part = F.pmod(F.xxhash64("text_hash"), F.lit(max(1, count // sample))) == 0
    sets = shingle_sets(texts.where(part)).groupBy("text_hash").agg(F.first("tokens").alias("tokens"))
    seen = sets.select(F.explode("tokens").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("rows"))
    rows = seen.where(F.col("rows") > 2).orderBy(F.desc("rows"), "token").limit(COMMON).collect()
    found = np.array([(row["token"], row["rows"]) for row in rows], np.int64).reshape(-1, 2)
    found = found[np.argsort(found[:, 0])]
    return found[:, 0].copy(), found[:, 1].copy()


def prefix_sets(texts: DataFrame, common: np.ndarray, rank: np.ndarray, shared: int = 1) -> DataFrame:
    """(text_hash, size, tokens): each different text once, with the shingles of its prefix."""
    order = texts.sparkSession.sparkContext.broadcast((common, rank))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles()
        for batch in small_batches(batches):
            sets = [shingles(text) for text in batch.column("text").to_pylist()]
            columns = [
                batch.column("text_hash"),
                pa.array([len(tokens) for tokens in sets], pa.int64()),
                pa.array([prefix(tokens, *order.value, shared) for tokens in sets], pa.list_(pa.int64())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["text_hash", "size", "tokens"])

    made = texts.select("text_hash", "text").mapInArrow(run, "text_hash long, size long, tokens array<long>")
    return made.groupBy("text_hash").agg(F.first(F.struct("size", "tokens")).alias("one")).select("text_hash", "one.*")


def fits(one: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return 5 * np.minimum(one, other) >= 4 * np.maximum(one, other)


def reach(size, place, before: int = 0):
    """Four times the largest size that can be similar, if a common shingle is at this place with ``before`` common ones in front."""
    return 5 * size - 9 * (place - before)


def within(size: np.ndarray, far: np.ndarray, size_: np.ndarray, far_: np.ndarray) -> np.ndarray:
    """Whether both sets reach the other."""
    return (4 * size_ <= far) & (4 * size <= far_)


PAIR_NAMES = ["a", "b", "token", "text_hash", "size", "place"]
PAIR_SCHEMA = "a long, b long, token long, text_hash long, size long, place long"


class FirstMeetings:
    """Rows sorted by (token, size, text) with their place: pairs of up to ``listed`` texts; of more, each with the first, and the rows.

    A listed pair may have met under one common shingle in front of this one, if that is crowded, and not under two.

    Between batches the rows of a token that may still have few are held, or the first row of a crowded one.
    """

    def __init__(self, listed: int):
        self.listed = listed
        self.held = tuple(np.empty(0, np.int64) for _ in range(4))
        self.crowded = False  # whether the row held is the first of a crowded token, and done

    def __call__(self, columns: list[np.ndarray], final: bool = False) -> pa.RecordBatch:
        token, _, size, place = rows = [np.concatenate(pair) for pair in zip(self.held, columns, strict=True)]
        if not len(token):
            return self.rows_of([], rows, np.empty(0, np.int64))
        new = np.append(True, token[1:] != token[:-1])
        run = np.cumsum(new) - 1
        first = np.flatnonzero(new)
        many = np.diff(np.append(first, len(token)))
        crowded = many > self.listed
        crowded[0] |= self.crowded
        waits = (run == run[-1]) & ~crowded[-1] & (not final)
        far = reach(size, place, 1)
        pairs = []
        for step in range(1, self.listed):
            left = np.flatnonzero((run[step:] == run[:-step]) & ~crowded[run[step:]] & ~waits[step:])
            left = left[within(size[left], far[left], size[left + step], far[left + step])]
            pairs.append((left, left + step))
        full = np.flatnonzero(crowded[run])
        later = full[full > first[run[full]]]
        pairs.append((first[run[later]], later))
        at = full[1:] if self.crowded else full  # the first row of a crowded token is given out once
        answer = self.rows_of(pairs, rows, at)
        keep = np.flatnonzero(waits) if not crowded[-1] else first[-1:]
        self.held, self.crowded = tuple(values[keep] for values in rows), bool(crowded[-1])
        return answer

    def rows_of(self, pairs: list, rows: list[np.ndarray], at: np.ndarray) -> pa.RecordBatch:
        """Pairs whose sizes fit, each once and the smaller hash first, and the rows ``at`` of crowded tokens."""
        _, text, size, _ = rows
        left, right = (np.concatenate([pair[i] for pair in pairs] or [np.empty(0, np.int64)]).astype(np.int64) for i in (0, 1))
        good = fits(size[left], size[right]) & (text[left] != text[right])
        found = np.unique(np.sort(np.column_stack([text[left[good]], text[right[good]]]), axis=1), axis=0)
        gap, rest = pa.nulls(len(found), pa.int64()), pa.nulls(len(at), pa.int64())
        arrays = [pa.concat_arrays([pa.array(found[:, i], pa.int64()), rest]) for i in range(2)]
        arrays += [pa.concat_arrays([gap, pa.array(values[at], pa.int64())]) for values in rows]
        return pa.RecordBatch.from_arrays(arrays, names=PAIR_NAMES)


def first_meetings(rows: DataFrame, listed: int) -> DataFrame:
    """Pairs (a, b) of the rows (token, text_hash, size, place), and the rows of crowded tokens."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        meet = FirstMeetings(listed)
        for batch in batches:
            if batch.num_rows:
                yield meet([column.to_numpy(zero_copy_only=False) for column in batch.columns])
        yield meet([np.empty(0, np.int64)] * 4, final=True)

    dealt = rows.select("token", "text_hash", "size", "place").repartition("token").sortWithinPartitions("token", "size", "text_hash")
    return dealt.mapInArrow(run, PAIR_SCHEMA)


def later_meetings(rows: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of different groups among the rows of ``mixed_keys`` with a key in common, in blocks of rows.

    A pair is given under the first key that both have, if a second one lets them be similar as well, and under every common
    key if one of the two is ``wide``. Without a column ``far`` sizes alone decide.
    """
    if "far" not in rows.columns:
        rows = rows.withColumns({"far": F.lit(np.iinfo(np.int64).max), "at": F.lit(0), "tokens": F.expr("array()"), "fars": F.expr("array()")})
    rows = mixed_rows(rows, "key")
    mixed = rows.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / block).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("text_hash"), F.col("blocks")).cast("int").alias("own")
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
    numbers = ["text_hash", "size", "root", F.col("wide").cast("int").alias("wide"), "far", "at"]
    lists = [F.col(name).cast("array<long>").alias(name) for name in ("tokens", "fars")]
    dealt = rows.join(mixed, "key").select("key", *numbers, *lists, own, other)
    numbers = ["text_hash", "size", "root", "wide", "far", "at", "own"]
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), *numbers, "tokens", "fars")

    def good(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
        (i, j, text, size, root, _, far, _, own), (_, _, text_, size_, root_, _, far_, _, own_) = left, right
        return fits(size, size_) & within(size, far, size_, far_) & (root != root_) & (((i == j) & (text != text_)) | (own != own_))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in _and_last(batches):
            if batch is not None and batch.num_rows:
                part = pa.Table.from_batches([batch])
                held = part if held is None else pa.concat_tables([held, part])
            elif batch is not None or held is None:
                continue
            columns = [column.to_numpy().astype(np.int64) for column in held.columns[:-2]]
            new = np.append(True, np.any([column[1:] != column[:-1] for column in columns[:3]], axis=0))
            edges = np.append(np.flatnonzero(new), len(new))
            done = len(edges) - (1 if batch is None else 2)
            end, sizes = edges[done], np.diff(edges[: done + 1])
            run_of, values = np.repeat(np.arange(done), sizes), [column[:end] for column in columns[1:]]
            chosen, found = FirstTwo(values, held[:end]), []
            short = sizes[run_of] <= SHORT
            for step in range(1, min(SHORT, end)):  # short runs of all keys at once
                left = np.flatnonzero((run_of[step:] == run_of[:-step]) & short[step:])
                left = left[good([v[left] for v in values], [v[left + step] for v in values])]
                found.append(chosen(left, left + step))
            for at in np.flatnonzero(sizes > SHORT).tolist():
                part = [v[edges[at] : edges[at + 1]] for v in values]
                for top in range(0, len(part[0]), STRIP):  # some rows against all behind them
                    rest = [v[top:] for v in part]
                    one, two = np.nonzero(np.triu(good([v[:STRIP, None] for v in rest], [v[None, :] for v in rest]), 1))
                    found.append(chosen(one + edges[at] + top, two + edges[at] + top))
                    if sum(map(len, found)) > PAIRS:
                        yield listed(found)
                        found = []
            held = held[end:]
            if found:
                yield listed(found)

    def listed(found: list[np.ndarray]) -> pa.RecordBatch:
        both = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0], pa.int64()), pa.array(both[:, 1], pa.int64())], names=["a", "b"])

    dealt = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


class FirstTwo:
    """Of pairs of rows those whose key is the first that both texts have, and which reach each other at the second as well."""

    def __init__(self, values: list[np.ndarray], rows: pa.Table):
        _, _, self.text, self.size, _, self.wide, _, self.at, _ = values
        tokens, fars = (rows.column(name).combine_chunks() for name in ("tokens", "fars"))
        ends = np.cumsum(np.append(0, tokens.value_lengths().to_numpy()))
        self.start, self.many = ends[:-1], np.diff(ends)
        known, self.token = np.unique(tokens.flatten().to_numpy(), return_inverse=True)
        self.far, self.kinds = fars.flatten().to_numpy(), max(1, len(known))
        entry = np.repeat(np.arange(len(self.many)), self.many) * self.kinds + self.token
        self.order = np.argsort(entry)
        self.entry = entry[self.order]

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        kept = [self.pick(left[top : top + CHECKED], right[top : top + CHECKED]) for top in range(0, len(left), CHECKED)]
        left, right = (np.concatenate([np.empty(0, np.int64), *[pair[i] for pair in kept]]) for i in (0, 1))
        return np.column_stack([self.text[left], self.text[right]])

    def pick(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        good = (self.wide[left] | self.wide[right]) > 0
        checked = np.flatnonzero(~good)
        if len(checked):
            one, two = left[checked], right[checked]
            place = np.arange(self.many[one].max())
            mine = self.start[one][:, None] + np.minimum(place, self.many[one][:, None] - 1)
            wanted = two[:, None] * self.kinds + self.token[mine]
            found = np.minimum(np.searchsorted(self.entry, wanted), len(self.entry) - 1)
            shared = (self.entry[found] == wanted) & (place < self.many[one][:, None])
            first = shared.argmax(axis=1) == self.at[one]
            shared &= place > self.at[one][:, None]
            row, second = np.arange(len(one)), shared.argmax(axis=1)
            far, far_ = self.far[mine[row, second]], self.far[self.order[found[row, second]]]
            good[checked] = first & shared.any(axis=1) & within(self.size[one], far, self.size[two], far_)
        return left[good], right[good]


def mixed_rows(rows: DataFrame, key: str) -> DataFrame:
    """The rows (key, text_hash, size, root, far, ...) that reach a size among those of their key, if these have several groups."""
    ends = rows.groupBy(key).agg(F.min("size").alias("_least"), F.max("far").alias("_most"))
    near = rows.join(ends, key).where("far >= 4 * _least and 4 * size <= _most").drop("_least", "_most")
    groups = near.groupBy(key).agg(F.min("root").alias("low"), F.max("root").alias("high"))
    return near.join(groups.where("low <> high").select(key), key, "left_semi")


def mixed_keys(left: DataFrame, wide: int = WIDE) -> DataFrame:
    """(key, text_hash, size, root, wide, far, at, tokens, fars) from the rows (token, text_hash, size, root, place) of mixed shingles.

    ``tokens`` are all of a text, in order, ``at`` is the place of the key among them, and ``far`` and ``fars`` say what the
    text reaches if the key is the first common one, or one of them the second. The lists of ``wide`` texts are left out.
    """
    texts = left.groupBy("text_hash", "size", "root").agg(F.array_sort(F.collect_set(F.struct("place", "token"))).alias("all"))
    is_wide = F.size("all") > wide
    listed = F.when(is_wide, F.slice("all", 1, 0)).otherwise(F.col("all"))
    fars = F.transform(listed, lambda one: reach(F.col("size"), one["place"], 1)).alias("fars")
    one = texts.select("text_hash", "size", "root", is_wide.alias("wide"), listed["token"].alias("tokens"), fars, F.posexplode("all").alias("at", "one"))
    far = reach(F.col("size"), F.col("one.place")).alias("far")
    return one.select(F.col("one.token").alias("key"), "text_hash", "size", "root", "wide", far, "at", "tokens", "fars")


def _and_last(batches: Iterator) -> Iterator:
    yield from batches
    yield None


def hubs(pairs: DataFrame, block: int) -> DataFrame:
    """(text_hash, hub, slot) of every text of a pair; those of a dense group mostly have one hub, and ``block`` of them a slot."""
    both = pairs.select("a", "b").unionAll(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("hub"))
    near = both.join(near.toDF("b", "hub"), "b").groupBy("a").agg(F.min("hub").alias("hub"))
    slots = near.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / block).alias("slots"))
    slot = F.pmod(F.xxhash64("a"), F.col("slots")).alias("slot")
    return near.join(slots, "hub").select(F.col("a").alias("text_hash"), "hub", slot)


def verified(pairs: DataFrame, texts: DataFrame, block: int = BLOCK) -> DataFrame:
    """The pairs (a, b) that are similar on their whole sets; a text travels once to each pair of slots that it has a pair in."""
    ends = reliable_checkpoint(hubs(pairs, block))
    bits = table_bits(ends.count())
    table = bit_table(ends.select("text_hash"), bits).alias("table")
    used = texts.select("text_hash", "text", table).where(passes(F.col("text_hash"), F.col("table"), bits)).select("text_hash", "text")
    used = used.join(ends.select("text_hash"), "text_hash", "left_semi").groupBy("text_hash").agg(F.first("text").alias("text"))
    dealt = pairs.join(ends.toDF("a", "hub_a", "slot_a"), "a").join(ends.toDF("b", "hub_b", "slot_b"), "b")
    dealt = reliable_checkpoint(dealt.select(F.xxhash64("hub_a", "slot_a", "hub_b", "slot_b").alias("slot"), "a", "b"))
    none = F.lit(None).cast("long")
    sides = dealt.select("slot", "a", none.alias("b")).unionAll(dealt.select("slot", none.alias("a"), "b")).distinct()
    sides = sides.withColumn("text_hash", F.coalesce("a", "b")).join(used, "text_hash").select("slot", "a", "b", "text")
    together = sides.unionAll(dealt.withColumn("text", F.lit(None).cast("string")))
    together = together.repartition("slot").sortWithinPartitions("slot", F.asc_nulls_first("b"), F.asc_nulls_first("a"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, here, held, other = Shingles(), None, {}, np.empty(0, np.int64)
        for batch in small_batches(batches):
            found: tuple[list, list] = ([], [])
            for slot, a, b, text in zip(*[batch.column(name).to_pylist() for name in ("slot", "a", "b", "text")], strict=True):
                if slot != here:
                    here, held = slot, {}
                if b is None:
                    held[a] = shingles(text)
                elif a is None:
                    other = shingles(text)
                elif similar(held[a], other):
                    found[0].append(a)
                    found[1].append(b)
            yield pa.RecordBatch.from_arrays([pa.array(values, pa.int64()) for values in found], names=["a", "b"])

    return together.mapInArrow(run, "a long, b long")


def overlap_links(texts: DataFrame, prints: DataFrame, links: DataFrame, listed: int = LISTED, block: int = BLOCK, wide: int = WIDE) -> DataFrame:
    """Links (u, v) of fingerprints that, with ``links``, connect all texts with a similarity of at least 4/5.

    ``texts`` has text_hash and text, ``prints`` one row (text_hash, print) per different text.
    """

    def named(pairs: DataFrame) -> DataFrame:
        one = prints.select(F.col("text_hash").alias("a"), F.col("print").alias("u"))
        two = prints.select(F.col("text_hash").alias("b"), F.col("print").alias("v"))
        links = reliable_checkpoint(pairs.join(one, "a").join(two, "b").where("u <> v").select("u", "v").distinct())
        release_shuffles(texts.sparkSession)  # of the texts that were compared
        return links

    order = often_seen(texts, prints.count())
    rows = prefix_sets(texts, *order, shared=2).select(F.posexplode("tokens").alias("place", "token"), "text_hash", "size")
    rows = rows.withColumn("place", F.col("place").cast("long"))
    swept = reliable_checkpoint(first_meetings(rows, listed))
    pairs = reliable_checkpoint(swept.where("a is not null").select("a", "b").distinct())
    found = named(verified(pairs, texts, block))
    crowded = swept.where("token is not null").select("token", "text_hash", "size", "place")
    if crowded.isEmpty():
        return found
    roots = component_roots(links.unionByName(found))
    grouped = prints.join(roots, prints["print"] == roots["node"], "left").select("text_hash", F.coalesce("root", "print").alias("root"))
    crowded = crowded.join(grouped, "text_hash").withColumn("far", reach(F.col("size"), F.col("place"), 1))
    left = reliable_checkpoint(mixed_rows(crowded, "token"))
    later = later_meetings(mixed_keys(left, wide), block)
    later = reliable_checkpoint(later.join(pairs, ["a", "b"], "left_anti"))
    release_shuffles(texts.sparkSession)  # of the rows that met
    return found.unionByName(named(verified(later, texts, block)))
