"""The bytes law, copies that stay together, slots without gaps, and odd tables."""

import random
import zlib
from collections import defaultdict

import pytest

from foldwise.llm.sharding import kd_shards

SCHEMA = "doc_id long, text string, source string, lang string, shard string, slot string"


def check(rows, found, shards):
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in found) == sorted((row[0] is None, row[0]) for row in rows)
    slots, weights = defaultdict(list), defaultdict(int)
    for row in found:
        slots[row["shard"]].append(row["slot"])
        weights[row["shard"]] += row["size"]
    assert set(slots) <= set(range(shards))
    assert all(sorted(taken) == list(range(len(taken))) for taken in slots.values())
    return [weights[shard] for shard in range(shards)]


@pytest.mark.parametrize("shards", [1, 4, 5, 16])
def test_bytes_are_near_equal_and_copies_together(table, shards):
    rng = random.Random(shards)
    texts = ["w" * rng.randint(1, 60) + str(i) for i in range(300)]
    rows = [(i, rng.choice(texts), f"s{i % 3 and i % 7}", "en", "x", "y") for i in range(2000)]
    found = kd_shards(table(rows, SCHEMA), shards=shards).collect()
    weights = check(rows, found, shards)
    assert max(weights) - min(weights) < 0.05 * sum(weights) / shards + 2 * max(r["size"] for r in found) * 10
    text_of = {row[0]: row[1] for row in rows}
    homes = defaultdict(set)
    for row in found:
        assert row["size"] == len(text_of[row["doc_id"]].encode()) + 1
        assert row["text_crc32"] == zlib.crc32(text_of[row["doc_id"]].encode())
        homes[text_of[row["doc_id"]]].add(row["shard"])
    assert sum(len(shards) > 1 for shards in homes.values()) <= shards


def test_one_text_everywhere_is_cut_by_id_and_row(table):
    rows = [(i // 2, "same", "s", "en", None, None) for i in range(64)]
    weights = check(rows, kd_shards(table(rows, SCHEMA), shards=8).collect(), 8)
    assert weights == [40] * 8


def test_repeated_rows_are_cut_too(table):
    rows = [(7, "same", None, None, None, None)] * 32
    assert check(rows, kd_shards(table(rows, SCHEMA), shards=4).collect(), 4) == [40] * 4


def test_missing_values_few_rows_and_none(table):
    rows = [(None, None, None, None, None, None), (1, "", None, "en", None, None), (None, "é", "s", None, None, None)]
    found = kd_shards(table(rows, SCHEMA), shards=16).collect()
    check(rows, found, 16)
    assert sorted(row["size"] for row in found) == [1, 1, 3]
    assert kd_shards(table([], SCHEMA), shards=16).collect() == []
    assert kd_shards(table([], SCHEMA), target_bytes=10).collect() == []


def test_target_bytes_set_the_number_of_shards(table):
    rows = [(i, "x" * 9, "s", "en", None, None) for i in range(50)]
    assert check(rows, kd_shards(table(rows, SCHEMA), target_bytes=100).collect(), 5) == [100] * 5
