"""A corpus cleaned and tokenized in five stages, each over all that the one before has kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a table that is written as
Parquet and read again for the next. All but the last return the columns of ``documents``.

Nulls, empty texts and repeated rows are treated as the operators say: a null or empty text fails the quality rules, so
later stages see none of it; of repeated rows one stays after near-duplicate removal; an empty table passes through
every stage as an empty table.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foldwise.llm.bpe import Vocabulary, decoded, encode, little_endian, read_ranks
from foldwise.llm.common import id_remainder
from foldwise.llm.decontamination import contaminated, find_passages
from foldwise.llm.language import UNKNOWN, fit_language, predict_language
from foldwise.llm.quality import fit_quality, judge_quality
from foldwise.llm.simhash import one_of_each_group
from foldwise.session import read_table, shared_folder

MIN_LANGUAGE_SCORE = 0.4
KNOWN_PIECES = 1 << 18  # a table a quarter as large as the operator's own, for a driver that has run four stages before
ORACLE_SQL = None  # the forest, the classifier and the byte-pair fold cannot be said in SQL


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that fail a base rule or that the isolation forest finds odd go."""
    model = fit_quality(docs, read_table(spark, sf_dir, "labels"))
    return judge_quality(docs, model, docs.columns).where("kept").select("row.*")


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a letter, or in no language that the classifier is at all sure of, go."""
    model = fit_language(docs, id_remainder("doc_id", 4) != 2)
    found = predict_language(docs, model, docs.columns)
    return found.where((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= MIN_LANGUAGE_SCORE)).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays.

    Near are texts within the operator's own radius, and texts with a similarity of 0.8 or more over five-word shingles.
    """
    return one_of_each_group(docs, overlap=True)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which a twentieth of the words or more are benchmark passages go."""
    found = find_passages(docs, read_table(spark, sf_dir, "benchmark"), docs.columns)
    return found.where(~contaminated(F.col("n_words"), F.col("n_hit"))).select("row.*")


def byte_bpe(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every document, with the digests of the ids and of the bytes they decode to."""
    vocabulary = Vocabulary(read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")), public_tokenizers.PATTERN)
    found = encode(docs, vocabulary, ["doc_id", "lang", "source"], known_pieces=KNOWN_PIECES)
    ids = F.col("ids")
    return found.select(
        "row.doc_id",
        "row.lang",
        "row.source",
        "ids",
        F.size(ids).cast("long").alias("n_tokens"),
        F.sha2(little_endian(ids, vocabulary), 256).alias("ids_sha256"),
        F.sha2(decoded(ids, vocabulary), 256).alias("decoded_sha256"),
    )


STAGES = [
    ("quality_rules", quality_rules),
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("decontamination", decontamination),
    ("byte_bpe", byte_bpe),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in turn, each written to the shared folder and read again."""
    folder = f"{shared_folder(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = read_table(spark, sf_dir, "documents")
    for place, (name, stage) in enumerate(STAGES):
        path = f"{folder}/{place}-{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
