"""Encoding against the tokenizer library, and the way back."""

import struct

import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from foldwise.llm import bpe

TEXTS = [
    None,
    "",
    " ",
    "\n\n  \t x",
    "I'm we'll you've it's 'S",
    "12 345 ٣½ ²  a1b2",
    "ñandú çà Üben straße 日本語テキスト 🙂🙂  　 \x85 end",
    "control \x01 and \x02 inside\x00",
    "a" * 700,
    "Unverhältnismäßigkeitsprüfungen" * 3,
    "tab\tand\r\nlines\r\n\r\n   ",
    "the the the the of and",
]


@pytest.fixture(scope="module")
def vocabulary():
    return bpe.Vocabulary(bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)


@pytest.mark.parametrize("known", [0, 1 << 20])
def test_encoding_equals_the_library_and_decodes_back(table, vocabulary, known):
    rows = [(i, text, "ids", "row") for i, text in enumerate(TEXTS * 2)]
    docs = table(rows, "doc_id long, text string, ids string, row string")
    found = bpe.encode(docs, vocabulary, docs.columns, known_pieces=known, sample=1)
    ids = F.col("ids")
    found = found.select("row.doc_id", "row.text", "ids", bpe.decoded(ids, vocabulary).alias("back"), bpe.little_endian(ids, vocabulary).alias("packed"))
    ranks = {token: i for i, token in enumerate(vocabulary.tokens)}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    answers = found.collect()
    assert len(answers) == len(rows)
    for row in answers:
        expected = library.encode_ordinary(row["text"] or "")
        assert row["ids"] == expected
        assert bytes(row["back"]) == (row["text"] or "").encode()
        assert bytes(row["packed"]) == struct.pack(f"<{len(expected)}I", *expected)


def test_no_documents_and_unknown_ids(spark, table, vocabulary):
    docs = table([], "doc_id long, text string")
    assert bpe.encode(docs, vocabulary, ["doc_id"]).count() == 0
    back = table([([0, 99_999_999],), ([-1],), (None,)], "ids array<int>").select(bpe.decoded(F.col("ids"), vocabulary).alias("b"))
    assert [row["b"] for row in back.collect()] == [None, None, None]


def test_a_vocabulary_without_gaps_and_with_every_byte(tmp_path):
    path = tmp_path / "ranks"
    path.write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError, match="gaps"):
        bpe.read_ranks(str(path))
    with pytest.raises(ValueError, match="every byte"):
        bpe.Vocabulary([b"a"], "x")


def test_the_fold_is_computed_once_for_each_piece(spark, vocabulary):
    df = spark.createDataFrame([("a",)], "piece string").select(F.col("piece"), F.lit(None).cast("array<map<bigint,int>>").alias("merges"))
    plan = df.select(bpe.encode_piece(F.col("piece"), vocabulary, F.col("merges")))._jdf.queryExecution().analyzed().toString()
    assert plan.count("array_min(") == plan.count("regexp_extract_all(")  # a fold named twice would have more
