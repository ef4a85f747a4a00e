"""The registered queries of this package, each over its whole table, and their SQL twins where SQL can say them."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import read_table, reliable_checkpoint, shared_folder
from .bpe import Vocabulary, decoded, encode, little_endian, read_ranks
from .common import id_remainder
from .decontamination import contaminated, find_passages
from .derivatives import BLOCKS, ENTITIES, HIDDEN, TAGS, derived_records, record_id
from .hmm import fit_hmm, score_texts
from .language import fit_language, predict_language
from .passages import remove_passages
from .periodic import find_runs
from .quality import BASE, fit_quality, judge_quality
from .rollups import Rollup, revised, signed
from .sharding import kd_shards
from .simhash import near_groups, print_hex
from .url_rules import judge_urls
from .variants import count_words, group_variants

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(function):
        QUERIES[name] = function
        if oracle:
            ORACLES[name] = oracle
        return function

    return register


VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@query("op1_byte_bpe")
def op1(spark, d):
    vocabulary = Vocabulary(read_ranks(VOCABULARY), public_tokenizers.PATTERN)
    found = encode(read_table(spark, d, "documents"), vocabulary, ["doc_id"])
    return found.select(
        "row.doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(little_endian(F.col("ids"), vocabulary), 256).alias("ids_sha256"),
        F.sha2(decoded(F.col("ids"), vocabulary), 256).alias("decoded_sha256"),
    )


@query("op2_sharding")
def op2(spark, d):
    placed = kd_shards(read_table(spark, d, "documents"), shards=16)
    return placed.withColumns({"law": F.lit("bytes"), "grown_shard": F.lit(None).cast("int")}).select(
        "doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"
    )


@query("op3_hmm_scores")
def op3(spark, d):
    docs = read_table(spark, d, "documents")
    held_out = id_remainder("doc_id", 10) == 0
    model = fit_hmm(docs, ~held_out)
    scored = score_texts(docs, model).withColumnRenamed("key", "doc_id")
    return scored.withColumns({"held_out": held_out, "train_tokens": F.lit(model.tokens).cast("long")}).select(
        "doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


@query("op4_simhash_near_dedup")
def op4(spark, d):
    found = near_groups(read_table(spark, d, "documents"))
    return found.select(F.col("key").alias("doc_id"), print_hex(F.col("print")).alias("fingerprint"), "component_id")


URL_RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]


@query(
    "op5_url_filters",
    """
    with u as (
        select page_id,
            coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') host,
            coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') path, row_number() over () rid
        from pages),
    r(verdict, h, p) as (values ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'),
        ('block', 'net', '/es/'), ('block', 'net', '/fr/')),
    m as (
        select u.rid, h || p rule, verdict, row_number() over (partition by u.rid order by length(h || p) desc) k
        from u join r on ('.' || host) like ('%.' || h) and starts_with(path, p))
    select page_id, host, path, rule, coalesce(verdict, 'allow') verdict
    from u left join (select * from m where k = 1) b using (rid)
    """,
)
def op5(spark, d):
    rules = spark.createDataFrame(URL_RULES, "verdict string, host string, path string")
    found = judge_urls(read_table(spark, d, "pages"), rules, ["page_id"])
    return found.select("row.page_id", "host", "path", "rule", "verdict")


@query("op6_quality_rules")
def op6(spark, d):
    docs = read_table(spark, d, "documents")
    model = fit_quality(docs, read_table(spark, d, "labels"))
    judged = judge_quality(docs, model, ["doc_id"])
    return judged.select("row.doc_id", *BASE, "base_failed", "kept", "anomaly")


WORDS, PARTS = r"[^\x20\x09-\x0D]+", r"[0-9]+|[A-Za-z]+|[^\x00-\x7F]+|[!-/:-@\[-`{-~]"


@query(
    "op7_token_rollups",
    f"""
    with d as (
        select source, lang, lang is not null and lang = 'en' english,
            coalesce(length(regexp_extract_all(text, '{WORDS}')), 0) words,
            coalesce(length(regexp_extract_all(text, '{PARTS}')), 0) parts,
            row_number() over (partition by text order by doc_id) k
        from documents)
    select source, lang, case when english then 'words-1' else 'parts-1' end version, count(*) n_docs,
        sum(case when english then words else parts end)::bigint n_tokens
    from d where k = 1 group by 1, 2, 3
    """,
)
def op7(spark, d):
    """All documents come in counted by words; copies are deleted; all but English is recounted; a batch is sent twice."""
    text = F.col("text")
    rows = read_table(spark, d, "documents").select(
        "doc_id", "source", "lang",
        F.xxhash64("text").alias("content"), F.octet_length("text").alias("size"),
        F.regexp_count(text, F.lit(WORDS)).alias("words"), F.regexp_count(text, F.lit(PARTS)).alias("parts"),
    )
    rows = reliable_checkpoint(rows)
    first = F.min(F.struct("doc_id", "source", "lang", "words", "parts")).alias("first")
    single = rows.groupBy("content", "size").agg(first).select("first.*")
    recounted = single.where(~F.coalesce(F.col("lang") == "en", F.lit(False)))
    rollup = Rollup(spark, f"{shared_folder(spark)}/rollup-{uuid.uuid4().hex}")
    rollup.commit("load", signed(rows, 1, "words-1", "words"))
    copies = signed(rows, -1, "words-1", "words").unionAll(signed(single, 1, "words-1", "words"))
    rollup.commit("copies", copies)
    rollup.commit("recount", revised(recounted, ("words-1", "words"), ("parts-1", "parts")))
    rollup.commit("copies", copies)
    return rollup.totals()


def plain_text_sql(html: str) -> str:
    for pattern, by in ((HIDDEN, ""), (BLOCKS, "\n"), (TAGS, "")):
        html = f"regexp_replace({html}, '{pattern}', '{by}', 'g')".replace("'\n'", "chr(10)")
    for name, character in ENTITIES:
        html = "replace({}, '{}', '{}')".format(html, name, character.replace("'", "''"))
    html = f"regexp_replace({html}, '[ \\t\\r\\f]+', ' ', 'g')"
    html = f"regexp_replace({html}, ' ?\\n[ \\n]*', chr(10), 'g')"
    return f"trim({html}, ' ' || chr(10))"


def record_id_sql(seed: str) -> str:
    cuts = " || '-' || ".join(f"substring(md5({seed}), {a}, {n})" for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))
    return f"'<urn:uuid:' || {cuts} || '>'"


CRAWLED = "2026-01-01T00:00:00Z"


@query(
    "op8_warc_derivatives",
    f"""
    with r as (
        select {record_id_sql("'response:' || page_id || ':' || coalesce(url, '')")} refers_to, coalesce(url, '') target_uri,
            '{CRAWLED}' date, 'text/html' source_content_type, coalesce(html, '') html
        from pages),
    f as (
        select refers_to, target_uri, date, source_content_type, strlen(html) source_content_length,
            'sha256:' || sha256(html) source_payload_digest, {plain_text_sql('html')} plain,
            regexp_replace({plain_text_sql("regexp_extract(html, '(?is)<title" + chr(92) + "b[^>]*>(.*?)</title', 1)")}, '\n+', ' ', 'g') title,
            regexp_extract(html, '(?i)<html\\b[^>]*\\blang="?([a-z-]+)', 1) lang,
            length(regexp_extract_all(html, '(?i)<a\\b[^>]*\\bhref=')) links
        from r),
    m as (
        select *, 'metadata' warc_type, 'application/warc-fields' content_type,
            'title: ' || title || e'\r\nlanguage: ' || lang || e'\r\noutlinks: ' || links || e'\r\nsource-target-uri: ' || target_uri
            || e'\r\nsource-content-type: ' || source_content_type || e'\r\nsource-content-length: ' || source_content_length
            || e'\r\nsource-payload-digest: ' || source_payload_digest || e'\r\n' block
        from f
        union all
        select *, 'conversion', 'text/plain', plain from f)
    select {record_id_sql("warc_type || ':' || refers_to")} record_id, warc_type, refers_to, target_uri, date, content_type,
        strlen(block) content_length, 'sha256:' || sha256(block) block_digest, source_content_type, source_content_length,
        source_payload_digest, block
    from m
    """,
)
def op8(spark, d):
    pages = read_table(spark, d, "pages")
    name = F.concat_ws(":", F.lit("response"), F.col("page_id").cast("string"), F.coalesce("url", F.lit("")))
    responses = pages.select(
        record_id(name).alias("record_id"),
        F.col("url").alias("target_uri"),
        F.lit(CRAWLED).alias("date"),
        F.lit("text/html").alias("content_type"),
        F.col("html").alias("payload"),
    )
    return derived_records(responses)


@query("op9_language_id")
def op9(spark, d):
    docs = read_table(spark, d, "documents")
    held_out = id_remainder("doc_id", 4) == 2
    model = fit_language(docs, ~held_out)
    found = predict_language(docs, model, ["doc_id"])
    return found.select("row.doc_id", "lang_pred", "score").withColumn("held_out", held_out).select(
        "doc_id", "held_out", "lang_pred", "score"
    )


def item_windows_sql(table: str, key: str) -> str:
    return f"""select {key}, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') w from {table}"""


@query(
    "op10_decontamination",
    f"""
    with i as ({item_windows_sql('benchmark', 'item_id')}),
    p as (
        select distinct item_id::varchar item_id, least(len(w), 13) n,
            array_to_string(w[s.k:s.k + least(len(w), 13) - 1], ' ') passage
        from i, lateral (select unnest(range(1, greatest(len(w) - 12, 1) + 1)) k) s where len(w) > 0),
    d as (select doc_id, row_number() over () rid, coalesce(w, []) w from ({item_windows_sql('documents', 'doc_id')})),
    lengths as (select distinct n from p),
    o as (
        select rid, k, l.n, array_to_string(w[k:k + l.n - 1], ' ') passage
        from (select rid, w, unnest(range(1, len(w) + 1)) k from d), lengths l where k + l.n - 1 <= len(w)),
    h as (select o.rid, o.k, p.n, p.item_id from o join p on o.passage = p.passage and o.n = p.n),
    hit as (select rid, count(distinct place) n_hit from (select rid, unnest(range(k, k + n)) place from (select distinct rid, k, n from h)) group by rid),
    it as (select rid, count(*) n_items, string_agg(item_id, ',' order by item_id) items from (select distinct rid, item_id from h) group by rid)
    select doc_id, len(w)::bigint n_words, coalesce(n_hit, 0)::bigint n_hit, coalesce(n_items, 0)::bigint n_items,
        sha256(coalesce(items, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) contaminated
    from d left join hit using (rid) left join it using (rid)
    """,
)
def op10(spark, d):
    found = find_passages(read_table(spark, d, "documents"), read_table(spark, d, "benchmark"), ["doc_id"])
    return found.select(
        "row.doc_id",
        "n_words",
        "n_hit",
        F.size("item_ids").cast("long").alias("n_items"),
        F.sha2(F.array_join("item_ids", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_words"), F.col("n_hit")).alias("contaminated"),
    )


def with_periodic_tail(key: str, words: list[bytes]) -> list[bytes]:
    """The words of the contract: of a tenth of the documents the words from one on repeat with a period."""
    h, n = zlib.crc32(key.encode()), len(words)
    if h % 10 or not n:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


@query("op11_periodic_runs")
def op11(spark, d):
    found = find_runs(read_table(spark, d, "documents"), ["doc_id"], rewrite=with_periodic_tail)
    line = F.transform("runs", lambda run: F.concat(F.concat_ws(",", run["start"], run["length"], run["period"]), F.lit("\n")))
    return found.select(
        "row.doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "longest.start",
        "longest.length",
        "longest.period",
        F.floor(1000 * F.col("longest.length") / F.col("longest.period")).alias("exponent_milli"),
        F.sha2(F.array_join(line, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query("op12_suffix_dedup")
def op12(spark, d):
    found = remove_passages(read_table(spark, d, "documents"), ["doc_id"])
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda total, span: total + span["stop"] - span["start"])
    return found.select(
        "row.doc_id",
        "n_bytes",
        removed.alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def dropped_letter(key: str) -> Callable[[str], str]:
    """The runs of the contract: in one of 31 a letter goes, by a checksum of id and run."""
    begun = zlib.crc32(f"{key}:".encode())

    def change(run: str) -> str:
        h = zlib.crc32(run.encode(), begun)
        if h % 31:
            return run
        at = h % len(run)
        return run[:at] + run[at + 1 :]

    return change


@query("op13_spelling_variants")
def op13(spark, d):
    words = count_words(read_table(spark, d, "documents"), rewrite=dropped_letter)
    return group_variants(words).select("word", "form", "root", "n", "n_near", "form_n")
