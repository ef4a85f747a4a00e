"""Fingerprints, the covering guarantee, and groups against a search over all pairs."""

import itertools
import random

import numpy as np
import xxhash
from conftest_llm import brute_roots

from foldwise.llm import simhash as sh

UNSIGNED = (1 << 64) - 1


def plain_fingerprint(text):
    words = text.encode().lower().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << bit for bit in range(64) if 2 * sum(h >> bit & 1 for h in hashes) > len(hashes))


def test_fingerprint_follows_its_definition(spark):
    for text in ["", " \t\n", "One", "one TWO", "a b c", "a b c d a b c", "É é x y z " * 40]:
        assert sh.fingerprint(text) & UNSIGNED == plain_fingerprint(text)
    assert sh.fingerprint(None) == 0
    # Spark's own xxhash64 has the same seed and agrees on a single shingle
    assert spark.sql("select xxhash64('a b c')").first()[0] & UNSIGNED == xxhash.xxh64_intdigest(b"a b c", 42)


def test_every_pair_within_the_radius_shares_a_table():
    rng = random.Random(1)
    for level in sh.table_masks():
        by_parent = {}
        for name, mask in level.items():
            by_parent.setdefault(name >> 4, []).append(mask)
        for masks in list(by_parent.values())[:5]:
            free = [bit for bit in range(64) if any(not mask >> bit & 1 for mask in masks)]
            for bits in [rng.sample(free, min(3, len(free))) for _ in range(300)]:
                change = sum(1 << bit for bit in bits)
                assert any(not change & mask for mask in masks)


def test_after_all_rounds_few_bits_are_free():
    assert max(64 - bin(mask).count("1") for mask in sh.table_masks()[-1].values()) <= 8


def groups_of(table, prints, bucket):
    rows = table([(p,) for p in prints], "print long")
    links = sh.print_links(rows, bucket=bucket).collect()
    for row in links:
        assert bin((row["u"] ^ row["v"]) & UNSIGNED).count("1") >= 1
    roots = {p: p for p in prints}
    found = brute_roots(prints, lambda a, b: False)
    for row in links:
        a, b = row["u"], row["v"]
        while found[a] != a:
            a = found[a]
        while found[b] != b:
            b = found[b]
        found[max(a, b)] = min(a, b)
    for p in roots:
        while found[found[p]] != found[p]:
            found[p] = found[found[p]]
    return {p: found[p] for p in prints}


def clustered(rng, centres, members):
    prints = set()
    for _ in range(centres):
        at = rng.getrandbits(64)
        for _ in range(members):
            for bit in rng.sample(range(64), rng.randint(0, 4)):
                at ^= 1 << bit
            prints.add(sh.signed(at & UNSIGNED))
    return sorted(prints)


def test_links_reach_what_all_pairs_reach_also_through_crowded_buckets(table):
    prints = clustered(random.Random(2), 12, 14)
    near = lambda a, b: bin((a ^ b) & UNSIGNED).count("1") <= 3
    expected = brute_roots(prints, near)
    assert groups_of(table, prints, 2048) == expected
    assert groups_of(table, prints, 3) == expected


def test_documents_against_brute_force(table):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") * rng.randint(1, 3) for _ in range(60)) for _ in range(6)]
    texts = [None, "", "  ", "x", "X", *base, *base[:2]]
    for text in base:
        words = text.split()
        words[5] = "changed"
        texts.append(" ".join(words))
    rows = [(i + 1, text, f"s{i}") for i, text in enumerate(texts)] + [(1, None, "again"), (None, base[0], "noid")]
    docs = table(rows, "doc_id long, text string, print string")
    found = sh.near_groups(docs).collect()
    assert len(found) == len(rows)
    prints = {i + 1: plain_fingerprint(text or "") for i, text in enumerate(texts)}
    expected = brute_roots(sorted(prints), lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 3)
    for row in found:
        if row["key"] is None:
            assert row["component_id"] == expected[texts.index(base[0]) + 1]
        else:
            assert row["print"] & UNSIGNED == prints[row["key"]]
            assert row["component_id"] == expected[row["key"]]


def test_one_document_of_each_group_stays(table):
    rows = [(3, "a b c d", "x"), (1, "a b c d", "y"), (1, "a b c d", "y"), (7, "quite another text", "z"), (9, None, None), (8, "", "")]
    docs = table(rows, "doc_id long, text string, source string")
    kept = sh.one_of_each_group(docs)
    assert kept.columns == docs.columns
    assert sorted(r["doc_id"] for r in kept.collect()) == [1, 7, 8]


def test_only_missing_ids_and_no_rows(table):
    docs = table([(None, "same text here"), (None, "same text here")], "doc_id long, text string")
    assert [r["component_id"] for r in sh.near_groups(docs).collect()] == [None, None]
    assert sh.one_of_each_group(docs).count() == 1
    assert sh.near_groups(docs.limit(0)).count() == 0
    assert sh.one_of_each_group(docs.limit(0)).count() == 0


def test_chains_of_links_are_one_component(table):
    from foldwise.llm.components import component_roots

    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (100, 100)]
    roots = dict(component_roots(table(chain, "u long, v long")).collect())
    assert roots == {i: 0 for i in range(41)} | {100: 100, 101: 100}
    assert np.array_equal(sorted(set(roots)), sorted(set(itertools.chain(*chain))))
