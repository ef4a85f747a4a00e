"""Near copies by overlap of five-word shingles against brute force over all pairs."""

import random

import pytest
from conftest_llm import brute_roots
from pyspark.sql import functions as F
from pyspark.sql import types as T

import corpus_pipeline as pipeline
from foldwise.llm import jaccard, simhash
from foldwise.llm.common import BATCH_ROWS, annotate
from foldwise.session import read_table

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def plain_set(text):
    words = (text or "").lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def plain_similar(a, b):
    return bool(a) and 5 * len(a & b) >= 4 * len(a | b)


def planted():
    """Texts with copies changed in a few words or cut, a crowd of near copies, a common line, and odd texts."""
    rng = random.Random(11)
    word = lambda: f"w{rng.randrange(3000)}"
    line = [word() for _ in range(30)]
    texts = []
    for n in (12, 40, 81, 150, 300, 700):
        for _ in range(3):
            base = [word() for _ in range(n)]
            texts.append(base)
            for changes in (1, max(1, n // 60), max(1, n // 45), max(1, n // 30)):
                copy = list(base)
                for at in rng.sample(range(n), changes):
                    copy[at] = word()
                texts.append(copy)
            texts += [base[: n * 5 // 6], base + [word() for _ in range(n // 6)]]
    crowd = [word() for _ in range(120)]
    for _ in range(30):
        copy = list(crowd)
        for at in rng.sample(range(120), 2):
            copy[at] = word()
        texts.append(copy)
    texts += [line + [word() for _ in range(k)] for k in (2, 4, 6, 8, 10, 12, 14, 16) * 3]
    texts = [" ".join(text) for text in texts]
    return [*texts, texts[0], texts[0].upper(), "a b", "a b c", "A B", "", None, " "]


def expected(texts, bits=3):
    sets = [plain_set(text) for text in texts]
    prints = [simhash.fingerprint(text) & (1 << 64) - 1 for text in texts]
    near = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= bits or plain_similar(sets[a], sets[b])
    return brute_roots(range(len(texts)), near)


def test_the_stage_finds_what_all_pairs_find(spark, table, small):
    texts = planted()
    sets = [plain_set(text) for text in texts]
    prints = [simhash.fingerprint(text) & (1 << 64) - 1 for text in texts]
    only = [
        (a, b)
        for a in range(len(texts))
        for b in range(a)
        if plain_similar(sets[a], sets[b]) and bin(prints[a] ^ prints[b]).count("1") > 3
    ]
    assert len(only) > 40  # what fingerprints alone miss
    docs = table([(i, text, "en", "s", len(text or "")) for i, text in enumerate(texts)], SCHEMA)
    found = pipeline.near_duplicates(spark, docs, small)
    assert {row["doc_id"] for row in found.collect()} == set(expected(texts).values())


@pytest.mark.parametrize("listed,block,wide,rows_a_batch", [(1, 1_024, 64, 10_000), (8, 3, 4, 10_000), (2, 5, 1, 7)])
def test_links_without_fingerprints_reach_every_similar_pair(spark, table, listed, block, wide, rows_a_batch):
    """Each text is its own node here, so the links have to connect all that is similar."""
    texts = list(dict.fromkeys(text for text in planted() if text and text.strip()))
    rows = table([(i, text) for i, text in enumerate(texts)], "text_hash long, text string")
    prints = rows.selectExpr("text_hash", "text_hash as print")
    none = table([], "u long, v long")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows_a_batch))
    try:
        links = {(row["u"], row["v"]) for row in jaccard.overlap_links(rows, prints, none, listed, block, wide).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sets = [plain_set(text) for text in texts]
    assert all(plain_similar(sets[a], sets[b]) for a, b in links)
    linked = brute_roots(range(len(texts)), lambda a, b: (a, b) in links or (b, a) in links)
    assert linked == brute_roots(range(len(texts)), lambda a, b: plain_similar(sets[a], sets[b]))


def test_the_given_documents_against_all_pairs(spark, small):
    docs = read_table(spark, small, "documents")
    rows = docs.select("doc_id", "text").collect()
    texts = [row["text"] for row in sorted(rows, key=lambda row: row["doc_id"])]
    names = sorted(row["doc_id"] for row in rows)
    stay = {names[root] for root in expected(texts).values()}
    assert {row["doc_id"] for row in pipeline.near_duplicates(spark, docs, small).collect()} == stay


def test_dissimilar_texts_with_a_common_shingle_are_not_compared_pair_by_pair(spark, monkeypatch):
    rng, compared = random.Random(3), []
    texts = ["one line that all share " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(1500)]
    texts += [texts[0] + " more", texts[1] + " more"]
    rows = spark.createDataFrame(list(enumerate(texts)), "text_hash long, text string")
    whole = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    # no sample, so the common shingle comes wherever its hash puts it, in the prefixes of many texts as well
    monkeypatch.setattr(jaccard, "often_seen", lambda *_: (jaccard.np.empty(0, "int64"), jaccard.np.empty(0, "int64")))
    links = jaccard.overlap_links(rows, rows.selectExpr("text_hash", "text_hash as print"), spark.createDataFrame([], "u long, v long"))
    assert {tuple(sorted(row)) for row in links.collect()} == {(0, 1500), (1, 1501)}
    assert sum(compared) < 3 * len(texts)


def test_a_task_holds_few_rows_at_a_time(spark):
    rows = spark.range(0, 3 * BATCH_ROWS + 5, 1, 1).select(F.col("id").alias("doc_id"), F.col("id").cast("string").alias("text"))
    start = lambda: lambda batch: {"held": [batch.num_rows] * batch.num_rows}
    seen = annotate(rows, ["doc_id"], {"text": F.col("text")}, start, [T.StructField("held", T.LongType())])
    assert [row["doc_id"] for row in seen.select("row.doc_id").collect()] == list(range(3 * BATCH_ROWS + 5))
    assert seen.agg(F.max("held")).first()[0] == BATCH_ROWS
    crowd = spark.range(600).select(F.lit(1).alias("key"), F.col("id").alias("text_hash"), F.lit(9).alias("size"), F.col("id").alias("root"), F.lit(True).alias("wide"))
    found = jaccard.later_meetings(crowd).collect()
    assert len(found) == len(set(found)) == 600 * 599 // 2 and all(row["a"] < row["b"] for row in found)


def test_texts_that_differ_too_much_from_a_large_cluster_are_not_compared_with_each_of_it(spark, monkeypatch):
    rng, compared = random.Random(8), []
    base = [f"w{rng.randrange(10**6)}" for _ in range(400)]

    def changed(step):
        """A word is another at every ``step`` places, from a start of the copy's own."""
        start = rng.randrange(step)
        return " ".join(f"v{rng.randrange(10**6)}" if at % step == start else word for at, word in enumerate(base))

    texts = [changed(200) for _ in range(60)] + [changed(28) for _ in range(60)]
    sets = [plain_set(text) for text in texts]
    assert not any(plain_similar(a, b) for a in sets[60:] for b in sets if a is not b)
    rows = spark.createDataFrame(list(enumerate(texts)), "text_hash long, text string")
    whole = jaccard.verified
    monkeypatch.setattr(jaccard, "verified", lambda pairs, *rest: compared.append(pairs.count()) or whole(pairs, *rest))
    none = spark.createDataFrame([], "u long, v long")
    links = jaccard.overlap_links(rows, rows.selectExpr("text_hash", "text_hash as print"), none)
    linked = {tuple(sorted(row)) for row in links.collect()}
    assert set(brute_roots(range(60), lambda a, b: (a, b) in linked or (b, a) in linked).values()) == {0}
    assert all(b < 60 for _, b in linked) and compared[-1] < 60  # 60 x 60 pairs at most


def test_texts_that_meet_much_of_the_same_travel_together(spark):
    pairs = spark.createDataFrame([(a, b) for a in range(30) for b in range(30, 60) if (a + b) % 3], "a long, b long")
    assert {row["hub"] for row in jaccard.hubs(pairs, 1024).collect()} <= {0, 1}
    sizes = [row["count"] for row in jaccard.hubs(pairs, 20).groupBy("hub", "slot").count().collect()]
    assert sum(sizes) == 60 and len(sizes) <= 5
