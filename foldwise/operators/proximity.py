"""Pairs of points of one group within a distance, for points of any dimension.

A projection on a unit vector never moves two points further apart, so points within the cutoff lie in the same or in
neighbouring cells of a grid of that side on a few projections. The directions are seeded; the ones on which the points
spread most are used, and only if they spread over more than two cells, as a grid costs copies of the rows. (Points that
lie all around a sphere no larger than the cutoff, like unit vectors, spread on none; their groups are one cell each.)

Crowded cells are cut into tiles by a hash, and each pair of tiles is a group of its own, so neither a crowded cell nor
one hot group ends up in one task. A pair of cells or tiles is compared in one order only, by one matrix product; only
true pairs leave the task, and are mirrored then. They are neither shuffled nor written on the way to the result.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.vectors import as_vector

TILE_ROWS = 2_000
EXACT_ROWS = 20_000
DIRECTIONS = 16
AXES = 3


def _projection(point: Column, direction: list[float]) -> Column:
    products = F.zip_with(point, F.array(*map(F.lit, direction)), lambda a, b: a * b)
    return F.aggregate(products, F.lit(0.0), lambda total, x: total + x)


def spread_directions(nodes: DataFrame, cutoff: float, vector: str = "embedding", axes: int = AXES, seed: int = 5) -> list[list[float]]:
    """At most ``axes`` seeded unit vectors, by falling spread of the points, over more than two cells each."""
    first = nodes.select(F.size(vector)).where(F.col(vector).isNotNull()).first()
    if not axes or first is None or first[0] < 1:
        return []
    drawn = np.random.default_rng(seed).normal(size=(DIRECTIONS, first[0]))
    drawn = (drawn / np.linalg.norm(drawn, axis=1, keepdims=True)).tolist()
    asked = []
    for i, direction in enumerate(drawn):
        place = _projection(as_vector(vector), direction)
        asked += [F.stddev_pop(place).alias(f"s{i}"), (F.max(place) - F.min(place)).alias(f"w{i}")]
    row = nodes.agg(*asked).first()
    wide = [i for i in range(DIRECTIONS) if row[f"w{i}"] is not None and row[f"w{i}"] > 2 * cutoff]
    return [drawn[i] for i in sorted(wide, key=lambda i: -row[f"s{i}"])[:axes]]


def listed_places(sources: pd.Series, listed: pd.Series, keys: pd.Series) -> tuple[np.ndarray, np.ndarray]:
    """Places (of the source, of the target among the keys) of all listed targets that are among the keys."""
    many = listed.map(len).to_numpy()
    if not many.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    named = pd.DataFrame({"row": np.repeat(np.arange(len(sources)), many), "key": np.concatenate([x for x in listed if len(x)])})
    met = named.merge(pd.DataFrame({"to": np.arange(len(keys)), "key": keys.to_numpy()}), "inner", "key")
    return met["row"].to_numpy(), met["to"].to_numpy()


def close_pairs(
    nodes: DataFrame,
    cutoff: float,
    group: str = "label",
    key: str = "record_id",
    vector: str = "embedding",
    axes: int = AXES,
    tile_rows: int = TILE_ROWS,
    without: DataFrame | None = None,
) -> DataFrame:
    """Ordered pairs (group, source, target, distance) with distance <= cutoff and source != target.

    Pairs of ``without`` (group, source, target) are left out where they are found, so that the pairs themselves are never
    shuffled: the targets of a source travel with it, to each tile those that are dealt there.
    """
    directions = spread_directions(nodes, cutoff, vector, axes)
    names = [f"_c{i}" for i in range(len(directions))]
    point = as_vector(vector)
    cells = [F.floor(_projection(point, d) / F.lit(float(cutoff))).alias(n) for d, n in zip(directions, names)]
    narrow = nodes.schema[vector].dataType.simpleString() == "array<float>"  # half as much to shuffle; widened in the tasks
    placed = nodes.select(F.col(group).alias("_group"), F.col(key).alias("_key"), (F.col(vector) if narrow else point).alias("_point"), *cells)
    nothing = F.array().cast(T.ArrayType(nodes.schema[key].dataType))
    if without is None:
        placed = placed.withColumn("_listed", nothing)
    else:
        source, target = (F.col(name).cast(nodes.schema[key].dataType) for name in ("source", "target"))
        targets = without.groupBy(F.col(group).alias("_group"), source.alias("_key")).agg(F.collect_set(target).alias("_listed"))
        placed = placed.join(targets, ["_group", "_key"], "left").withColumn("_listed", F.coalesce("_listed", nothing))
    sizes = placed.groupBy("_group", *names).agg(F.count(F.lit(1)).alias("_rows"))
    # Of a cell and its neighbours only those behind it in the order of the coordinates, so each pair of cells is met once.
    moves = [m for m in reduce(lambda rows, _: [r + (d,) for r in rows for d in (-1, 0, 1)], names, [()]) if m >= (0,) * len(names)]
    number = F.explode(F.array(*[F.struct(F.lit(i).alias("_move"), *[F.lit(d).alias(n) for d, n in zip(m, names)]) for i, m in enumerate(moves)]))
    zero = moves.index((0,) * len(names))
    reach = sizes.select("*", number.alias("_m")).select(
        "_group",
        F.col("_m._move").alias("_move"),
        *[F.col(n).alias(f"_t{n}") for n in names],
        *[(F.col(n) - F.col(f"_m.{n}")).alias(n) for n in names],
        F.col("_rows").alias("_target_rows"),
    )
    pairs = reach.join(sizes.withColumnRenamed("_rows", "_source_rows"), ["_group", *names])
    tiles = {"_a": "_source_rows", "_b": "_target_rows"}
    pairs = pairs.withColumns({n: F.greatest(F.lit(1), F.ceil(F.col(rows) / F.lit(tile_rows))).cast("int") for n, rows in tiles.items()})
    inside = F.col("_move") == zero
    on = ["_group", "_move", *names, "_i", "_j"]
    # A hash of the key, not of the row order, decides the tile. Inside a cell tile i meets the tiles from i on.
    near = pairs.select("_group", "_move", *names, "_a", "_b")
    own = F.pmod(F.xxhash64("_key"), F.col("_a")).cast("int").alias("_i")
    left = placed.join(near, ["_group", *names]).select("*", own)
    left = left.withColumn("_j", F.explode(F.sequence(F.when(inside, F.col("_i")).otherwise(F.lit(0)), F.col("_b") - 1)))
    left = left.withColumn("_listed", F.filter("_listed", lambda k: F.pmod(F.xxhash64(k), F.col("_b")) == F.col("_j")))
    far = pairs.select("_group", "_move", *names, *[f"_t{n}" for n in names], "_a", "_b")
    moved = placed.select("_group", "_key", "_point", "_listed", *[F.col(n).alias(f"_t{n}") for n in names])
    own = F.pmod(F.xxhash64("_key"), F.col("_b")).cast("int").alias("_j")
    right = moved.join(far, ["_group", *[f"_t{n}" for n in names]]).select("*", own)
    right = right.withColumn("_i", F.explode(F.sequence(F.lit(0), F.when(inside, F.col("_j")).otherwise(F.col("_a") - 1))))
    right = right.withColumn("_listed", F.filter("_listed", lambda k: F.pmod(F.xxhash64(k), F.col("_a")) == F.col("_i")))
    left, right = (side.select(*on, "_key", "_point", "_listed") for side in (left, right))
    # Both sides descend from the same table; new names keep their columns apart.
    right = right.toDF(*[f"{c}_right" for c in right.columns])
    limit = float(cutoff)

    def compare(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            nothing = np.empty(0, dtype=object)
            no = np.empty(0, dtype=bool)
            return pd.DataFrame({group: nothing, "a": nothing, "b": nothing, "distance": np.empty(0), "ab": no, "ba": no})
        head = left.iloc[0]
        a, b = (np.stack(points.to_numpy()).astype(np.float64, copy=False) for points in (left["_point"], right["_point_right"]))
        # The product form is fast but rounds; it only picks candidates, with room to spare.
        squares = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2.0 * (a @ b.T)
        slack = 1e-9 * (1.0 + (a * a).sum(axis=1).max() + (b * b).sum(axis=1).max())
        i, j = np.nonzero(squares <= limit * limit + slack)
        one, two = left["_key"].to_numpy()[i], right["_key_right"].to_numpy()[j]
        once = one < two if head["_move"] == zero and head["_i"] == head["_j"] else one != two
        i, j, one, two = i[once], j[once], one[once], two[once]
        exact = np.empty(len(i))  # in parts, as the differences take a whole point for each pair
        for start in range(0, len(i), EXACT_ROWS):
            part = slice(start, start + EXACT_ROWS)
            exact[part] = np.sqrt(((a[i[part]] - b[j[part]]) ** 2).sum(axis=1))
        kept = exact <= limit
        out = pd.DataFrame({"a": one[kept], "b": two[kept], "distance": exact[kept]})
        out.insert(0, group, head["_group"])
        place = i[kept] * len(b) + j[kept]
        row, to = listed_places(left["_key"], left["_listed"], right["_key_right"])
        out["ab"] = ~np.isin(place, row * len(b) + to)
        row, to = listed_places(right["_key_right"], right["_listed_right"], left["_key"])
        out["ba"] = ~np.isin(place, to * len(b) + row)
        return out[out["ab"] | out["ba"]]

    fields = [(group, nodes.schema[group]), ("a", nodes.schema[key]), ("b", nodes.schema[key])]
    more = [("distance", T.DoubleType()), ("ab", T.BooleanType()), ("ba", T.BooleanType())]
    schema = T.StructType([T.StructField(n, f.dataType) for n, f in fields] + [T.StructField(n, kind) for n, kind in more])
    found = left.groupBy(*on).cogroup(right.groupBy(*[f"{c}_right" for c in on])).applyInPandas(compare, schema)
    ways = [F.struct(F.col(x).alias("source"), F.col(y).alias("target"), F.col(x + y).alias("_new")) for x, y in ("ab", "ba")]
    return found.select(group, F.inline(F.array(*ways)), "distance").where("_new").drop("_new")


def proximity_edges(
    nodes: DataFrame,
    listed: DataFrame,
    cutoff: float,
    group: str = "label",
    key: str = "record_id",
    vector: str = "embedding",
    **options,
) -> DataFrame:
    """Listed edges, close pairs that are not listed, and a self-loop for a group with neither.

    ``listed`` holds (group, source, target); columns out: group, source, target, kind. The self-loop
    sits on the least key of the group.
    """
    listed = listed.select(group, "source", "target")
    added = close_pairs(nodes, cutoff, group, key, vector, without=listed, **options).select(group, "source", "target")
    edges = listed.withColumn("kind", F.lit("listed")).unionByName(added.withColumn("kind", F.lit("proximity")))
    # A group with a listed edge has one, so close pairs are looked for once more only in the others. One row per group
    # and task meets the groups; the edges of a group would all be read by one task.
    bare = nodes.join(listed.select(group).distinct(), group, "left_anti")
    near = close_pairs(bare, cutoff, group, key, vector, **options).select(group).distinct()
    lonely = bare.groupBy(group).agg(F.min(key).alias("source")).join(near, group, "left_anti")
    loops = lonely.select(group, "source", F.col("source").alias("target"), F.lit("self").alias("kind"))
    return edges.unionByName(loops)
