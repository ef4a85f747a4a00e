"""Byte-level BPE in Spark's own functions: higher-order functions fold ranked merges over the bytes of a word.

A text is cut by the tokenizer's pattern. The bytes of a piece start as one token each; a fold then replaces, again
and again, the leftmost of the adjacent pairs with the lowest rank, which is what the byte-pair rule asks for. The
rank map holds, for every token, the ways to put it together from two others, in buckets of maps from pair to token.
After a merge only the two pairs beside it are looked up again.

Distinct words that are frequent in a hash sample of the documents (at most ``known_pieces`` of at most ``PIECE_BYTES``
bytes, which bounds the size of the table) are encoded once. Every other piece is folded where it stands. The sample
decides how often the fold runs, never what comes out. Both tables are scalar subqueries, computed once and put into
the tasks as literals. A text is encoded inside its own row, so neither a hot source nor a frequent word is gathered
anywhere, and what is shuffled does not grow with the documents' text.

Decoding looks up the bytes of each id and concatenates them. A null text is encoded as an empty one: no ids. An id
outside the vocabulary makes the decoded bytes null. A piece of n bytes costs up to n steps over n tokens, so one
unbroken run of letters of many thousand characters is slow, but right. Repeated rows are encoded alike.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import kept, reliable_checkpoint
from .common import packed

NO_MERGE = 2**31 - 1
REST = 2**30  # longer than any array
EDGE = 2**31 - 1  # no token has this number
LOW = 2**32 - 1
BUCKETS = 1 << 16
KNOWN_PIECES = 1 << 20
PIECE_BYTES = 48
SAMPLE = 8
# fixed value: the characters with Unicode's White_Space property
WHITE = r"\t-\r \x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
KNOWN_BUCKETS = 1 << 18


def read_ranks(path: str) -> list[bytes]:
    """The tokens of a rank file (base64 and rank per line), in order of their rank."""
    with open(path, "rb") as lines:
        ranks = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
    if sorted(ranks) != list(range(len(ranks))):
        raise ValueError("the ranks of a vocabulary have to be 0, 1, 2, ... without gaps")
    return [ranks[i] for i in range(len(ranks))]


@dataclass
class Vocabulary:
    """Tokens by id, with the literals that encoding and decoding look things up in."""

    tokens: list[bytes]
    pattern: str

    def __post_init__(self):
        self.ids = {token: i for i, token in enumerate(self.tokens)}
        missing = [b for b in range(256) if bytes([b]) not in self.ids]
        if missing:
            raise ValueError(f"a byte-level vocabulary has a token for every byte; missing: {missing[:5]}")

    def pairs(self) -> list[tuple[int, int, int]]:
        """(left, right, whole) for each way to join two tokens into a third."""
        return [
            (self.ids[token[:cut]], self.ids[token[cut:]], whole)
            for whole, token in enumerate(self.tokens)
            for cut in range(1, len(token))
            if token[:cut] in self.ids and token[cut:] in self.ids
        ]

    def merges(self, spark: SparkSession) -> DataFrame:
        """One row: buckets of maps from a pair, as one number, to the joined token, which is also the rank."""
        pairs = spark.createDataFrame(self.pairs(), "left long, right long, whole int")
        entry = F.struct(pair_key(F.col("left"), F.col("right")).alias("key"), F.col("whole").alias("value"))
        return bucketed(pairs.select((pair_bucket(F.col("left"), F.col("right")) + 1).alias("bucket"), entry.alias("entry")), BUCKETS)

    def byte_ids(self) -> Column:
        return literal([str(self.ids[bytes([b])]) for b in range(256)]).cast("array<int>")

    def token_hex(self) -> Column:
        return literal([token.hex() for token in self.tokens])

    def id_hex(self) -> Column:
        """Each id as a little-endian unsigned 32-bit number."""
        return literal([i.to_bytes(4, "little").hex() for i in range(len(self.tokens))])

    @property
    def java_pattern(self) -> str:
        """The pattern with Unicode's white space spelled out, as Java's own class holds only ASCII."""
        inside = self.pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]")
        return inside.replace(r"\s", f"[{WHITE}]")


def literal(texts: list[str]) -> Column:
    return F.split(F.lit(" ".join(texts)), " ")


def pair_bucket(left: Column, right: Column) -> Column:
    return F.pmod(left * 40503 + right, F.lit(BUCKETS)).cast("int")


def pair_key(left: Column, right: Column) -> Column:
    return F.shiftleft(left, 32).bitwiseOR(right)


def bucketed(entries: DataFrame, buckets: int) -> DataFrame:
    """One row with an array of ``buckets`` maps, from ``entries`` of a bucket (from 1) and a (key, value) entry.

    As a scalar subquery it is computed once and becomes a literal of the tasks, but not of the printed plan.
    """
    nothing = F.lit(None).cast(entries.schema["entry"].dataType).alias("entry")
    every = entries.sparkSession.range(1, buckets + 1).select(F.col("id").cast("int").alias("bucket"), nothing)
    maps = entries.union(every).groupBy("bucket").agg(F.map_from_entries(F.collect_list("entry")).alias("found"))
    rows = F.array_sort(F.collect_list(F.struct("bucket", "found")), lambda a, b: a["bucket"] - b["bucket"])
    return maps.agg(F.transform(rows, lambda row: row["found"]).alias("maps"))


def bound(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def encode_piece(piece: Column, vocabulary: Vocabulary, merges: Column) -> Column:
    """The ids of one piece of text, by folding merges over its bytes."""

    def entry(left: Column, right: Column) -> Column:
        """A token, below the rank of its pair with the next one: the joined token, or the rank that never merges."""
        found = F.try_element_at(F.get(merges, pair_bucket(left, right)), pair_key(left, right))
        return pair_key(F.coalesce(found, F.lit(NO_MERGE)).cast("bigint"), left)

    def token(entry: Column) -> Column:
        return entry.bitwiseAND(F.lit(LOW))

    digits = F.regexp_extract_all(F.hex(F.encode(piece, "UTF-8")), F.lit(".."), F.lit(0))
    byte_ids = vocabulary.byte_ids()
    single = F.transform(digits, lambda two: F.element_at(byte_ids, F.conv(two, 16, 10).cast("int") + 1).cast("bigint"))
    edge = F.lit(EDGE).cast("bigint")

    def merge(state: Column, best: Column) -> Column:
        """The entries with one pair merged; ``best`` has its rank, and below that the place of its left token, from 0."""
        place, whole = token(best).cast("int"), F.shiftright(best, 32)
        beside = F.array(entry(token(state[place - 1]), whole), entry(whole, token(state[place + 2])))
        return F.concat(F.slice(state, 1, place - 1), beside, F.slice(state, place + 3, REST))

    def step(state: Column, _: Column) -> Column:
        best = F.array_min(F.transform(state, lambda one, place: one.bitwiseAND(F.lit(~LOW)).bitwiseOR(place)))
        return bound(best, lambda best: F.when(best >= NO_MERGE << 32, state).otherwise(merge(state, best)))

    def folded(tokens: Column) -> Column:
        start = F.transform(tokens, lambda left, place: entry(left, F.coalesce(F.get(tokens, place + 1), edge)))
        # the ids are read where the fold ends: an expression that is named twice is computed twice
        ids = lambda state: F.transform(F.slice(state, 2, F.greatest(F.size(state) - 2, F.lit(0))), lambda one: token(one).cast("int"))
        return F.aggregate(F.slice(tokens, 3, REST), start, step, ids)

    return bound(F.concat(F.array(edge), single, F.array(edge)), folded)


def pieces_of(text: Column, vocabulary: Vocabulary) -> Column:
    return F.regexp_extract_all(F.coalesce(text.cast("string"), F.lit("")), F.lit(vocabulary.java_pattern), F.lit(0))


def known_table(
    docs: DataFrame, text: str, vocabulary: Vocabulary, merges: DataFrame, known_pieces: int, sample: int
) -> DataFrame:
    """One row with an array of ``KNOWN_BUCKETS`` maps, from the frequent pieces of a bucket to their ids.

    The least count that leaves at most ``known_pieces`` pieces is read from a histogram of the counts.
    """
    drawn = docs.select(F.col(text).cast("string").alias("text")).where(F.pmod(F.xxhash64("text"), F.lit(sample)) == 0)
    counts = drawn.select(F.explode(pieces_of(F.col("text"), vocabulary)).alias("piece")).groupBy("piece").count()
    counts = counts.where(F.octet_length("piece") <= PIECE_BYTES)
    with kept(counts) as counted:
        histogram = counted.groupBy("count").agg(F.count(F.lit(1)).alias("pieces")).orderBy(F.desc("count")).collect()
        least, room = 2**62, known_pieces
        for row in histogram:
            room -= row["pieces"]
            if room < 0:
                break
            least = row["count"]
        chosen = counted.where(F.col("count") >= least).select("piece")
        ids = bound(F.col("merges"), lambda merges: encode_piece(F.col("piece"), vocabulary, merges))
        # written once: the counts behind it are let go, and the subquery below only gathers it
        encoded = reliable_checkpoint(chosen.select("piece", merges.scalar().alias("merges")).select("piece", ids.alias("ids")))
    entry = F.struct(F.col("piece").alias("key"), F.col("ids").alias("value"))
    return bucketed(encoded.select((known_bucket(F.col("piece")) + 1).alias("bucket"), entry.alias("entry")), KNOWN_BUCKETS)


def known_bucket(piece: Column) -> Column:
    return F.pmod(F.hash(piece), F.lit(KNOWN_BUCKETS))


def encode(
    docs: DataFrame,
    vocabulary: Vocabulary,
    keep: list[str],
    text: str = "text",
    known_pieces: int = KNOWN_PIECES,
    sample: int = SAMPLE,
) -> DataFrame:
    """Documents as ``row``, with the array ``ids``."""
    merges = vocabulary.merges(docs.sparkSession)
    known = known_table(docs, text, vocabulary, merges, known_pieces, sample)
    tables = F.struct(known.scalar().alias("known"), merges.scalar().alias("merges")).alias("tables")
    cut = docs.select(packed(docs, keep), pieces_of(F.col(text), vocabulary).alias("pieces"), tables)

    def ids_of(known: Column, merges: Column) -> Column:
        def one(piece: Column) -> Column:
            found = F.try_element_at(F.get(known, known_bucket(piece)), piece)
            return F.coalesce(found, encode_piece(piece, vocabulary, merges))

        return F.flatten(F.transform(F.col("pieces"), one))

    return cut.select("row", bound(F.col("tables"), lambda tables: ids_of(tables["known"], tables["merges"])).alias("ids"))


def decoded(ids: Column, vocabulary: Vocabulary) -> Column:
    """The bytes behind an array of ids: binary pieces, concatenated; null if an id is unknown."""
    digits = vocabulary.token_hex()
    known = (F.size(ids) == 0) | ((F.array_min(ids) >= 0) & (F.array_max(ids) < len(vocabulary.tokens)))
    return F.when(known, F.unhex(F.array_join(F.transform(ids, lambda i: F.get(digits, i)), "")))


def little_endian(ids: Column, vocabulary: Vocabulary) -> Column:
    """An array of ids of the vocabulary as unsigned 32-bit numbers, one after another."""
    digits = vocabulary.id_hex()
    return F.unhex(F.array_join(F.transform(ids, lambda i: F.get(digits, i)), ""))
