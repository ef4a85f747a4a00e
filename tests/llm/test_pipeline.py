"""Every stage against a plain recomputation on the driver, and the pipeline on odd tables."""

import hashlib
import struct

import public_tokenizers
import pytest
import tiktoken
from conftest_llm import brute_roots
from test_decontamination import brute as passages

import corpus_pipeline as pipeline
from foldwise.llm import bpe, language, quality, simhash
from foldwise.llm.common import id_remainder
from foldwise.session import read_table


@pytest.fixture(scope="module")
def stages(spark, small, tmp_path_factory):
    """The input of every stage, and the result."""
    docs, tables = read_table(spark, small, "documents"), []
    for place, (_, stage) in enumerate(pipeline.STAGES):
        tables.append(docs)
        path = str(tmp_path_factory.mktemp("stage") / str(place))
        stage(spark, docs, small).write.parquet(path)
        docs = spark.read.parquet(path)
    return [*tables, docs]


def shingle_set(text):
    words = text.encode().lower().split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def rows_of(df):
    return {row["doc_id"]: row for row in df.collect()}


def test_all_stages_but_the_last_keep_the_columns(stages):
    assert all(df.columns == stages[0].columns for df in stages[:5])
    assert all(0 < after.count() <= before.count() for before, after in zip(stages[:4], stages[1:5]))


def test_quality_and_language_decisions(spark, small, stages):
    model = quality.fit_quality(stages[0], read_table(spark, small, "labels"))

    def good(text):
        base = quality.base_statistics(text)
        score = model.forest.scores(quality.np.array([quality.shares(text, base)]))[0]
        return not quality.base_failed(base) and score <= model.threshold

    assert set(rows_of(stages[1])) == {key for key, row in rows_of(stages[0]).items() if good(row["text"])}
    fitted = language.fit_language(stages[1], id_remainder("doc_id", 4) != 2)
    said = {key: fitted.predict(row["text"]) for key, row in rows_of(stages[1]).items()}
    kept = {key for key, (name, score) in said.items() if name != "und" and score >= pipeline.MIN_LANGUAGE_SCORE}
    assert set(rows_of(stages[2])) == kept


def test_one_of_each_near_group_stays_and_passages_go(spark, small, stages):
    before = rows_of(stages[2])
    prints = {key: simhash.fingerprint(row["text"]) & (1 << 64) - 1 for key, row in before.items()}
    sets = {key: shingle_set(row["text"]) for key, row in before.items()}

    def linked(a, b):
        return bin(prints[a] ^ prints[b]).count("1") <= 3 or 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])

    roots = brute_roots(sorted(prints), linked)
    assert set(rows_of(stages[3])) == set(roots.values())
    items = [(row["item_id"], row["text"]) for row in read_table(spark, small, "benchmark").collect()]
    clean = {key for key, row in rows_of(stages[3]).items() if not (lambda n, hit, _: hit and 20 * hit >= n)(*passages(row["text"], items))}
    assert set(rows_of(stages[4])) == clean


def test_tokens_are_the_librarys(stages):
    tokens = bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(tokens)}, special_tokens={})
    before, after = rows_of(stages[4]), rows_of(stages[5])
    assert set(before) == set(after)
    for key, row in after.items():
        ids = library.encode_ordinary(before[key]["text"])
        assert row["ids"] == ids and row["n_tokens"] == len(ids)
        assert row["ids_sha256"] == hashlib.sha256(struct.pack(f"<{len(ids)}I", *ids)).hexdigest()
        assert row["decoded_sha256"] == hashlib.sha256(before[key]["text"].encode()).hexdigest()


def test_nulls_repeats_and_no_rows_pass_through(spark, table, small):
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    text = "several quite ordinary words stand here so that the rule on length is met by this text of many words in one line of plain prose"
    rows = [(1, text, "en", "s", 5), (1, text, "en", "s", 5), (2, None, None, None, None), (None, text, None, None, None), (3, "", "en", "s", 0)]
    for docs in (table(rows, schema), table([], schema)):
        expected = docs.count() and 1
        for _, stage in pipeline.STAGES:
            docs = stage(spark, docs, small)
        assert docs.count() == expected


def test_extra_columns_with_names_used_inside_stay(table, small):
    names = ["row", "key", "print", "_identity", "first", "text_hash", "root", "ids", "a", "b"]
    text = "several quite ordinary words stand here so that the rule on length is met by this text of many words in one line of plain prose"
    schema = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{name}` string" for name in names)
    docs = table([(1, text, "en", "s", 5, *names), (2, text, "en", "s", 5, *names)], schema)
    columns, spark = docs.columns, docs.sparkSession
    for _, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, small)
        assert docs.columns == columns
    assert [tuple(row)[5:] for row in docs.collect()] == [tuple(names)]
    assert [row["doc_id"] for row in pipeline.STAGES[4][1](spark, docs, small).collect()] == [1]
