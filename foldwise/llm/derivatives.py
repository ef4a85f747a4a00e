"""Derived WARC records: for each response a metadata record and a plain-text conversion, linked to it.

Both records name the response in ``WARC-Refers-To`` and keep its target, date, content type, length and payload digest
as source headers; each has a digest of its own block. Record ids are made from the response's id and the record's
type, so a second run gives the same records.

Text: comments, scripts and styles go, tags of blocks become line breaks and other tags nothing, common named entities
become their characters (any other stays as it is), runs of blanks and of line breaks become one. All of it is column
expressions, one row at a time and without a shuffle; a long page is no more than a long row.

A null payload is an empty one and gives an empty text; a null target or date gives an empty header. A response with a
null id gets the id of the empty text. Repeated responses give repeated records.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# fixed values: names of the Web's markup and of WARC fields
HIDDEN = r"(?is)<!--.*?-->|<script\b.*?</script\s*>|<style\b.*?</style\s*>"
BLOCKS = (
    r"(?i)</?(?:address|article|aside|blockquote|body|br|dd|div|dl|dt|fieldset|figcaption|figure|footer|form|h1|h2|h3|h4|h5|h6"
    r"|head|header|hr|html|li|main|nav|ol|option|p|pre|section|table|td|th|title|tr|ul)\b[^>]*>"
)
TAGS = r"<[a-zA-Z/!?][^>]*>"
ENTITIES = [
    ("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&apos;", "'"), ("&#39;", "'"),
    ("&copy;", "©"), ("&middot;", "·"), ("&hellip;", "…"), ("&ndash;", "–"), ("&mdash;", "—"), ("&amp;", "&"),
]
CONVERSION, METADATA = "conversion", "metadata"


def plain_text(html: Column) -> Column:
    text = F.regexp_replace(html, HIDDEN, "")
    text = F.regexp_replace(text, BLOCKS, "\n")
    text = F.regexp_replace(text, TAGS, "")
    for name, character in ENTITIES:
        text = F.replace(text, F.lit(name), F.lit(character))
    text = F.regexp_replace(text, r"[ \t\r\f]+", " ")
    text = F.regexp_replace(text, r" ?\n[ \n]*", "\n")
    return F.btrim(text, F.lit(" \n"))


def digest(block: Column) -> Column:
    return F.concat(F.lit("sha256:"), F.sha2(block.cast("binary"), 256))


def record_id(seed: Column) -> Column:
    """A name-based identifier of the form that record ids have."""
    name = F.md5(seed.cast("binary"))
    cuts = [F.substring(name, start, size) for start, size in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *cuts), F.lit(">"))


def metadata_block(html: Column, target: Column, content_type: Column, payload_digest: Column) -> Column:
    """What is known of the response, as named fields, one per line."""
    title = F.regexp_replace(plain_text(F.regexp_extract(html, r"(?is)<title\b[^>]*>(.*?)</title", 1)), r"\n+", " ")
    fields = {
        "title": title,
        "language": F.regexp_extract(html, r"(?i)<html\b[^>]*\blang=\"?([a-z-]+)", 1),
        "outlinks": F.regexp_count(html, F.lit(r"(?i)<a\b[^>]*\bhref=")).cast("string"),
        "source-target-uri": target,
        "source-content-type": content_type,
        "source-content-length": F.octet_length(html).cast("string"),
        "source-payload-digest": payload_digest,
    }
    return F.concat(*[part for name, value in fields.items() for part in (F.lit(f"{name}: "), value, F.lit("\r\n"))])


def derived_records(responses: DataFrame) -> DataFrame:
    """Records from ``record_id``, ``target_uri``, ``date``, ``content_type`` and ``payload`` of responses; other columns are not read."""
    names = ("record_id", "target_uri", "date", "content_type", "payload")
    held = responses.select(*[F.coalesce(F.col(name).cast("string"), F.lit("")).alias(name) for name in names])
    held = held.withColumn("payload_digest", digest(F.col("payload")))
    made = F.array(
        F.struct(
            F.lit(METADATA).alias("warc_type"),
            F.lit("application/warc-fields").alias("content_type"),
            metadata_block(*[F.col(name) for name in ("payload", "target_uri", "content_type", "payload_digest")]).alias("block"),
        ),
        F.struct(
            F.lit(CONVERSION).alias("warc_type"), F.lit("text/plain").alias("content_type"), plain_text(F.col("payload")).alias("block")
        ),
    )
    rows = held.select(
        F.col("record_id").alias("refers_to"),
        "target_uri",
        "date",
        F.col("content_type").alias("source_content_type"),
        F.octet_length("payload").cast("long").alias("source_content_length"),
        F.col("payload_digest").alias("source_payload_digest"),
        F.explode(made).alias("made"),
    )
    return rows.select(
        record_id(F.concat_ws(":", "made.warc_type", "refers_to")).alias("record_id"),
        "made.warc_type",
        "refers_to",
        "target_uri",
        "date",
        "made.content_type",
        F.octet_length("made.block").cast("long").alias("content_length"),
        digest(F.col("made.block")).alias("block_digest"),
        "source_content_type",
        "source_content_length",
        "source_payload_digest",
        "made.block",
    )


def serialised(records: DataFrame) -> DataFrame:
    """Each record as the text of a WARC record, without the two line ends that close it."""
    fields = {
        "WARC-Type": "warc_type",
        "WARC-Record-ID": "record_id",
        "WARC-Date": "date",
        "WARC-Target-URI": "target_uri",
        "WARC-Refers-To": "refers_to",
        "WARC-Block-Digest": "block_digest",
        "WARC-Source-Payload-Digest": "source_payload_digest",
        "WARC-Source-Content-Type": "source_content_type",
        "WARC-Source-Content-Length": "source_content_length",
        "Content-Type": "content_type",
        "Content-Length": "content_length",
    }
    head = [part for name, column in fields.items() for part in (F.lit(f"{name}: "), F.col(column).cast("string"), F.lit("\r\n"))]
    return records.select(F.concat(F.lit("WARC/1.1\r\n"), *head, F.lit("\r\n"), "block").alias("value"))


def write_records(records: DataFrame, folder: str) -> None:
    """Write the records as compressed WARC text, one file per partition."""
    serialised(records).write.option("lineSep", "\r\n\r\n").option("compression", "gzip").text(folder)
