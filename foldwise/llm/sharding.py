"""Shards of near equal bytes by a k-d tree over the documents' metadata.

The tree starts with all rows. A node is cut at the weighted median, by bytes, of its widest metadata dimension (width
relative to that of the whole table), and so on until every leaf is one shard, that is until it has come down to the
target bytes. A number of shards that is no power of two cuts at the fitting share instead of one half.

Medians are found without sorting: a pass sums bytes in ``HISTOGRAM`` equal ranges of a node's open interval, the range
with the median becomes the interval, and ties go on to the next of (dimension, text checksum, size, id, row number).
All nodes of a level share a pass, and only their histograms come to the driver. The cut is exact to one row.

Equal texts have equal metadata here, that of their smallest id, so they stay together wherever the cut allows: a group
of copies is cut only if it weighs more than ``WHOLE_SHARE`` of its node, otherwise the cut moves to its nearer edge.

A null text weighs 1 byte and has checksum 0; null source, language or id sort first. Repeated rows are told apart by a
row number, so they too can be cut. An empty table gives no rows. With fewer rows than shards some shards are empty.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import reliable_checkpoint

HISTOGRAM = 512
WHOLE_SHARE = 0.01
LOW, HIGH = -(2**63), 2**63 - 1
ORDER = ["value", "text_crc32", "size", "id_key", "row_id"]


def described(docs: DataFrame, key: str, text: str, dimensions: tuple[str, ...]) -> DataFrame:
    """id, size, checksum, one number per dimension, and a row number; rows of equal texts have equal numbers."""
    content = F.coalesce(F.col(text).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(content) + 1).cast("bigint").alias("size"),
        F.crc32(content).cast("bigint").alias("text_crc32"),
        F.xxhash64(content).alias("digest"),
        *[F.coalesce(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(-1)).cast("bigint").alias(f"d{i}") for i, name in enumerate(dimensions)],
    )
    names = [f"d{i}" for i in range(len(dimensions))]
    same = ["digest", "text_crc32", "size"]  # 96 bits and the size stand for the text
    groups = rows.groupBy(*same).agg(F.min(F.struct("doc_id", *names)).alias("first"))
    groups = groups.select(*same, *[f"first.{name}" for name in names])
    joined = rows.select("doc_id", *same).join(groups, same).drop("digest")
    numbered = joined.withColumns(
        {
            f"d{len(dimensions)}": F.col("size"),
            "id_key": F.coalesce(F.col("doc_id").cast("bigint"), F.lit(LOW)),
            "row_id": F.monotonically_increasing_id(),
        }
    )
    return reliable_checkpoint(numbered)  # fixes the row numbers


@dataclass
class Node:
    """A node of the current level: its shards, and where the search for its cut has come to."""

    shards: int
    first: int
    weight: int = 0
    dimension: int = 0
    place: int = 0
    fixed: list[int] = field(default_factory=lambda: [0] * len(ORDER))
    low: int = 0
    high: int = -1
    before: int = 0
    cut: tuple | None = None


def at_node(values: list) -> Column:
    """The value of a row's node."""
    return F.get(F.array(*[F.lit(v).cast("bigint") for v in values]), F.col("node"))


def order_values(rows: DataFrame, dimensions: int, nodes: list[Node]) -> list[Column]:
    picked = F.get(F.array(*[F.col(f"d{i}") for i in range(dimensions)]), at_node([n.dimension for n in nodes]).cast("int"))
    return [picked, *[F.col(name) for name in ORDER[1:]]]


def narrowed(rows: DataFrame, nodes: list[Node], dimensions: int) -> None:
    """One pass: the histograms of all nodes that are still open, each of which goes on to the range of its median."""
    values = order_values(rows, dimensions, nodes)
    here = F.get(F.array(*values), at_node([min(n.place, len(ORDER) - 1) for n in nodes]).cast("int"))
    low, high = at_node([n.low for n in nodes]), at_node([n.high for n in nodes])
    inside = (here >= low) & (here <= high) & at_node([int(n.cut is None) for n in nodes]).cast("boolean")
    for i, value in enumerate(values[:-1]):
        inside &= (at_node([n.place for n in nodes]) <= i) | (value == at_node([n.fixed[i] for n in nodes]))
    # a range may be one off where the quotient is rounded; ranges stay in order, and that is all the search needs
    halved = [int(n.high - n.low >= 2**62) for n in nodes]  # where a difference might not fit into 64 bits
    wide = at_node([max(1, -(-(n.high - n.low + 1) // (HISTOGRAM << half))) for n, half in zip(nodes, halved, strict=True)])
    away = F.when(at_node(halved) == 1, F.shiftright(here, 1) - F.shiftright(low, 1)).otherwise(here - low)
    sums = [F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows")]
    sums += [edge(f"v{i}").alias(f"{edge.__name__}{i}") for i in range(len(ORDER)) for edge in (F.min, F.max)]
    ranges = (
        rows.where(inside)
        .select("node", F.floor(away / wide).alias("range"), "size", *[v.alias(f"v{i}") for i, v in enumerate(values)])
        .groupBy("node", "range")
        .agg(*sums)
        .orderBy("node", "range")
        .collect()
    )
    for number, node in enumerate(nodes):
        own = [row for row in ranges if row["node"] == number]
        if node.cut is None and own:
            choose(node, own)


def choose(node: Node, ranges: list) -> None:
    """Keep the range in which the wanted share of the bytes is reached, or settle the cut."""
    target = node.weight * (node.shards // 2) / node.shards
    for row in ranges:
        if node.before + row["bytes"] >= target:
            break
        node.before += row["bytes"]
    least = [row[f"min{i}"] for i in range(len(ORDER))]
    most = [row[f"max{i}"] for i in range(len(ORDER))]
    node.fixed = least
    node.place = next((i for i in range(len(ORDER)) if least[i] != most[i]), len(ORDER))
    one_text = node.place >= 3  # the rest of the order are ids of copies
    if node.place == len(ORDER) or one_text and row["bytes"] <= WHOLE_SHARE * node.weight:
        nearer_left = target - node.before > row["bytes"] / 2
        edge = HIGH if nearer_left else LOW
        node.cut = (*least[: node.place], *[edge] * (len(ORDER) - node.place))
        if node.place == len(ORDER) and not nearer_left:
            node.cut = (*least[:-1], least[-1] - 1)
    else:
        node.low, node.high = least[node.place], most[node.place]


def opened(rows: DataFrame, nodes: list[Node], dimensions: int, widths: list[int] | None) -> list[int]:
    """Weight and widest dimension of every node; the widths of the first node are the measure for all."""
    edges = [edge(f"d{i}").alias(f"{edge.__name__}{i}") for i in range(dimensions) for edge in (F.min, F.max)]
    found = rows.groupBy("node").agg(F.sum("size").alias("bytes"), *edges).collect()
    for row in found:
        spans = [row[f"max{i}"] - row[f"min{i}"] for i in range(dimensions)]
        widths = widths or spans
        node = nodes[row["node"]]
        node.weight = row["bytes"]
        node.dimension = max(range(dimensions), key=lambda i: (spans[i] / max(1, widths[i]), -i))
        node.low, node.high = row[f"min{node.dimension}"], row[f"max{node.dimension}"]
    for node in nodes:
        if node.shards < 2 or not node.weight:
            node.cut = (HIGH,) * len(ORDER)  # everything to the left
    return widths or [0] * dimensions


def kd_shards(
    docs: DataFrame,
    shards: int | None = None,
    target_bytes: int | None = None,
    key: str = "doc_id",
    text: str = "text",
    dimensions: tuple[str, ...] = ("source", "lang"),
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot; give the number of shards or the bytes a shard should have."""
    rows = described(docs, key, text, dimensions)
    axes = len(dimensions) + 1
    if shards is None:
        total = rows.agg(F.sum("size")).first()[0] or 0
        shards = max(1, -(-total // target_bytes))
    nodes, widths = [Node(shards, 0)], None
    rows = rows.withColumn("node", F.lit(0))
    while any(node.shards > 1 for node in nodes):
        widths = opened(rows, nodes, axes, widths)
        while any(node.cut is None for node in nodes):
            narrowed(rows, nodes, axes)
        past = F.lit(False)  # whether a row comes after its node's cut, from the last part of the order to the first
        for i, value in reversed(list(enumerate(order_values(rows, axes, nodes)))):
            edge = at_node([node.cut[i] for node in nodes])
            past = (value > edge) | ((value == edge) & past)
        left, below = [], []
        for node in nodes:
            left.append(len(below))
            half = node.shards // 2
            below += [Node(half, node.first), Node(node.shards - half, node.first + half)] if node.shards > 1 else [Node(1, node.first)]
        rows = rows.withColumn("node", (at_node(left) + past.cast("bigint")).cast("int"))
        rows, nodes = reliable_checkpoint(rows), below  # a level's passes then read one flat, narrow table
    placed = rows.withColumn("shard", at_node([node.first for node in nodes]).cast("int"))
    return with_slots(placed).select("doc_id", "size", "text_crc32", "shard", "slot")


def with_slots(rows: DataFrame) -> DataFrame:
    """Places 0, 1, 2, ... within each shard, by row number: rows of earlier parts of the table, plus those before in its own."""
    parts = rows.withColumn("part", F.shiftright("row_id", 33))  # a row number starts with its part
    sizes = parts.groupBy("shard", "part").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("shard").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("shard", "part", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    own = F.row_number().over(Window.partitionBy("shard", "part").orderBy("row_id")) - 1
    return parts.withColumn("own", own).join(offsets, ["shard", "part"]).withColumn("slot", F.col("offset") + F.col("own"))
