"""Totals equal a recount whatever the order, repeats and interruptions of batches."""

import random
import shutil
from collections import Counter
from pathlib import Path

import pytest

from foldwise.llm.rollups import Rollup, revised, signed

SCHEMA = "doc_id long, source string, lang string, old long, new long, version string"


def recount(rows, version, place):
    totals = Counter()
    for row in rows:
        totals[(row[1], row[2], version, "docs")] += 1
        totals[(row[1], row[2], version, "tokens")] += row[place] or 0
    return totals


def seen(rollup):
    found = Counter()
    for row in rollup.totals().collect():
        found[(row["source"], row["lang"], row["version"], "docs")] += row["n_docs"]
        found[(row["source"], row["lang"], row["version"], "tokens")] += row["n_tokens"]
    return {k: v for k, v in found.items() if v}


@pytest.mark.parametrize("order", [0, 1])
def test_signed_batches_add_up_to_a_recount(spark, table, tmp_path, order):
    rng = random.Random(1)
    rows = [(i, rng.choice(["a", "b", None]), rng.choice(["en", None]), rng.randint(0, 9), rng.choice([None, 3]), "x") for i in range(60)]
    whole, gone, changed = table(rows, SCHEMA), table(rows[:20], SCHEMA), table(rows[20:45], SCHEMA)
    batches = [
        ("in", signed(whole, 1, "v1", "old")),
        ("out", signed(gone, -1, "v1", "old")),
        ("revised", revised(changed, ("v1", "old"), ("v2", "new"))),
    ]
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.totals().count() == 0 and rollup.committed() == []
    for name, changes in reversed(batches) if order else batches:
        assert rollup.commit(name, changes)
        assert not rollup.commit(name, changes)
    expected = recount(rows[20:45], "v2", 4) + recount(rows[45:], "v1", 3)
    assert seen(rollup) == {k: v for k, v in expected.items() if v}
    assert rollup.committed() == ["in", "out", "revised"]


def test_an_interrupted_batch_does_not_count_and_is_written_anew(spark, table, tmp_path):
    docs = table([(1, "s", "en", 5, 0, "")], SCHEMA)
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    rollup.commit("one", signed(docs, 1, "v", "old"))
    (Path(rollup.folder) / "batch-one" / "_SUCCESS").unlink()
    assert rollup.committed() == [] and rollup.totals().count() == 0
    assert rollup.commit("one", signed(docs, 1, "v", "old"))
    assert seen(rollup) == {("s", "en", "v", "docs"): 1, ("s", "en", "v", "tokens"): 5}
    shutil.rmtree(rollup.folder)


def test_empty_batches_and_bad_names(spark, table, tmp_path):
    rollup = Rollup(spark, str(tmp_path / "rollup"))
    assert rollup.commit("none", signed(table([], SCHEMA), 1, "v", "old"))
    assert rollup.committed() == ["none"] and rollup.totals().count() == 0
    with pytest.raises(ValueError):
        rollup.commit("a/b", table([], SCHEMA))
