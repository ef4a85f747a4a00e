"""Near pairs, forms and roots against plain comparison of all words, and odd texts."""

import random
import zlib
from collections import Counter

import pytest

from foldwise.llm import catalog, variants
from foldwise.session import read_table


def one_edit(a, b):
    """Exactly one code point inserted, deleted or replaced."""
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(counts, neighbours=None):
    near = neighbours or {a: [b for b in counts if one_edit(a, b)] for a in counts}
    forms = {}
    for word, n in counts.items():
        best = min(near[word], key=lambda other: (-counts[other], other), default=None)
        forms[word] = best if best and counts[best] >= 10 * n else None
    rows = set()
    for word, n in counts.items():
        root = word
        while forms[root]:
            root = forms[root]
        rows.add((word, forms[word], root, n, len(near[word]), counts.get(forms[word])))
    return rows


def rows_of(df):
    return {tuple(row) for row in df.select("word", "form", "root", "n", "n_near", "form_n").collect()}


@pytest.mark.parametrize("alphabet,least,most,seed", [("ab", 7, 9, 1), ("abé", 7, 8, 2), ("abcÿ", 7, 14, 3), ("ab", 1, 6, 4)])
def test_dense_vocabularies(spark, alphabet, least, most, seed):
    rng = random.Random(seed)
    words = {"".join(rng.choice(alphabet) for _ in range(rng.randint(least, most))) for _ in range(220)}
    for word in list(words)[:60]:  # neighbours of every kind, so that long words have some as well
        i = rng.randrange(len(word))
        words |= {word[:i] + word[i + 1 :], word[:i] + rng.choice(alphabet) + word[i:], word[:i] + rng.choice(alphabet) + word[i + 1 :]}
    counts = {word: rng.choice([2, 3, 20, 30, 300, 4000]) for word in words if word}
    table = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert rows_of(variants.group_variants(table)) == brute(counts)


def test_every_near_pair_meets_whatever_the_length_and_place_of_the_edit(spark):
    rng = random.Random(5)
    expected = set()
    for length in [*range(7, 26), 61, 200]:
        word = "".join(rng.choice("abcdefghij") for _ in range(length))
        for i in range(length + 1):
            expected.add(tuple(sorted([word, word[:i] + "x" + word[i:]])))
            if i < length:
                expected.add(tuple(sorted([word, word[:i] + "x" + word[i + 1 :]])))
    words = {word for pair in expected for word in pair}
    table = spark.createDataFrame([(word, 2) for word in words], "word string, n long")
    found = {tuple(sorted([row["a"], row["b"]])) for row in variants.near_pairs(table).collect()}
    assert expected <= found and all(one_edit(*pair) for pair in found)
    assert variants.near_pairs(table).count() == len(found)


def test_long_chains_end_at_their_root(spark):
    chain = [(f"chainword{'x' * i}", 10**i * 2) for i in range(17)]
    table = spark.createDataFrame([*chain, ("unrelated", 5)], "word string, n long")
    found = {row["word"]: row["root"] for row in variants.group_variants(table).collect()}
    assert found == {word: chain[-1][0] for word, _ in chain} | {"unrelated": "unrelated"}


def contract_words(rows):
    """Counts of the contract's words, character by character."""
    counts = Counter()
    for key, text in rows:
        run = ""
        for c in (text or "") + " ":
            if "A" <= c <= "Z" or "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c.lower() if c <= "Z" else c
                continue
            if run:
                h = zlib.crc32(f"{key}:{run}".encode())
                if h % 31 == 0:
                    i = h % len(run)
                    run = run[:i] + run[i + 1 :]
                counts[run] += 1
            run = ""
    return {word: n for word, n in counts.items() if len(word) >= 7 and n >= 2}


def test_query_equals_plain_python(spark, small):
    counts = contract_words([(row["doc_id"], row["text"]) for row in read_table(spark, small, "documents").collect()])
    gaps, near = {}, {word: set() for word in counts}
    for word in counts:
        for i in range(len(word) + 1):
            gaps.setdefault((word[:i], word[i:], "in"), set()).add(word)
            if i < len(word):
                gaps.setdefault((word[:i], word[i + 1 :], "out"), set()).add(word)
    for (left, right, kind), group in gaps.items():
        others = group | gaps.get((left, right, "in"), set()) if kind == "out" else ()
        for word in others:
            near[word] |= {other for other in others if one_edit(word, other)}
    found = catalog.QUERIES["op13_spelling_variants"](spark, small)
    assert found.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert rows_of(found) == brute(counts, {word: sorted(group) for word, group in near.items()})


def test_odd_rows(spark, table):
    text = "Separate SEPARATE seperate, Éseparate×÷ x" + " separatE" * 30
    rows = [(1, text, "w"), (1, text, "w"), (None, text, None), (2, None, "w"), (3, "", "w"), (4, "123 " * 5000 + "seperate" * 1 + " y" * 70_000, "w")]
    docs = table(rows, "doc_id long, text string, word string")
    found = rows_of(variants.group_variants(variants.count_words(docs, flush=2)))
    assert found == {("separate", None, "separate", 96, 1, None), ("seperate", "separate", "separate", 4, 1, 96), ("Éseparate×÷", None, "Éseparate×÷", 3, 0, None)}
    assert rows_of(variants.group_variants(variants.count_words(docs.limit(0)))) == set()
