"""Wu-Manber search against a comparison at every position."""

import random
import re

import pytest

from foldwise.llm import decontamination as D

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def plain_words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(text, items, window=13):
    words, hit, names = plain_words(text), set(), set()
    for name, item in items:
        own = plain_words(item)
        if not own:
            continue
        size = min(window, len(own))
        for start in range(len(own) - size + 1):
            for at in range(len(words) - size + 1):
                if words[at : at + size] == own[start : start + size]:
                    hit.update(range(at, at + size))
                    names.add("" if name is None else str(name))
    return len(words), len(hit), sorted(names)


@pytest.mark.parametrize("seed", range(4))
def test_search_finds_every_occurrence(seed):
    rng = random.Random(seed)
    alphabet = [bytes([c]) for c in b"abc"]
    patterns = {tuple(rng.choices(alphabet, k=rng.randint(1 if seed == 3 else 2, 6))): [] for _ in range(25)}
    words = rng.choices(alphabet, k=400)
    found = sorted(D.WuManber(patterns).occurrences(words))
    every = sorted((i, p) for i in range(len(words)) for p in patterns if tuple(words[i : i + len(p)]) == p)
    assert found == every


@pytest.mark.parametrize("block_bytes", [1 << 20, 60])
def test_documents_against_brute_force(table, block_bytes):
    rng = random.Random(7)
    vocabulary = ["ab", "Éa", "x1", "Q", "zz", "of"]
    say = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    items = [(1, say(20)), (2, say(13)), (3, say(4)), (30, "Q-zz!"), (4, None), (5, " .. "), (None, say(15)), (1, say(14))]
    texts = [None, "", "...", say(5), say(300)]
    texts += [f"{say(9)} {text.upper()}, {say(30)}" for _, text in items if text]
    rows = [(i, text, "spans", 5) for i, text in enumerate(texts + texts[-1:])]
    docs = table(rows, "doc_id long, text string, spans string, n_words int")
    found = D.find_passages(docs, table(items, "item_id long, text string"), docs.columns, block_bytes=block_bytes)
    answers = found.select("row.doc_id", "row.text", *[f.name for f in D.FIELDS]).collect()
    assert len(answers) == len(rows)
    for row in answers:
        assert (row["n_words"], row["n_hit"], row["item_ids"]) == brute(row["text"], items)
        assert sum(end - start for start, end in row["spans"]) == row["n_hit"]


def test_without_items_or_documents(table):
    docs, items = table([(1, "a b c")], "doc_id long, text string"), table([], "item_id long, text string")
    row = D.find_passages(docs, items, ["doc_id"]).first()
    assert (row["n_words"], row["n_hit"], row["item_ids"], row["spans"]) == (3, 0, [], [])
    assert D.find_passages(docs.limit(0), items, ["doc_id"]).count() == 0
