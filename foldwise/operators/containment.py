"""Which test passages appear, character for character, inside which training texts.

Comparing every text with every passage would be a cross join. A text that contains a passage also contains the words
strictly inside it, in order. So all runs of inner words of the passages are put into a bit table, and one pass over the
texts keeps those of their own runs that the table lets through; only these are rows. Counted, they tell in how many
texts each run of a passage occurs. A passage with a run that no text has is out; of the others the rarest run is the
anchor by which candidates are found, and these are verified on the whole strings. Passages too short to have an inner
word are looked up through their own characters in the same way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bittable import bit_table, passes, table_bits
from ..session import collect_small, reliable_checkpoint

ANCHOR_WORDS = 5
SPLIT = r"\s+"


def _runs(words: Column, length: int) -> Column:
    """Digests of all runs of ``length`` words (or letters) of a list column, each once, from shifted
    copies of the list."""
    count = F.size(words) - (length - 1)
    shifted = [F.slice(words, k + 1, F.greatest(count, F.lit(0))) for k in range(length)]
    digests = F.transform(F.arrays_zip(*shifted), lambda z: F.xxhash64(F.lit(length), *[z[str(k)] for k in range(length)]))
    return F.array_distinct(digests)


def passage_overlap(
    documents: DataFrame,
    items: DataFrame,
    document_key: str = "doc_id",
    item_key: str = "item_id",
    text: str = "text",
    anchor_words: int = ANCHOR_WORDS,
) -> DataFrame:
    """Pairs (document, item) where the whole item text occurs in the whole document text."""
    passages = items.filter(F.length(text) > 0).select(F.col(item_key), F.col(text).alias("_passage"))
    words = F.split("_passage", SPLIT)
    inner = F.slice(words, 2, F.greatest(F.size(words) - 2, F.lit(0)))
    letters = F.filter(F.split("_passage", ""), lambda c: c != "")
    # Kinds: n > 0 are runs of n inner words, n < 0 a passage of -n characters without an inner word.
    length = F.least(F.size("_inner"), F.lit(anchor_words))
    passages = passages.withColumn("_inner", inner).withColumn("_kind", F.when(length > 0, length).otherwise(-F.size(letters)))
    # The kinds in use are few: at most ``anchor_words`` run lengths and the lengths of short passages.
    kinds = sorted(row[0] for row in collect_small(passages.select("_kind").distinct(), what="anchor lengths"))
    if not kinds:
        return documents.select(document_key).join(items.select(item_key), F.lit(False))
    own = F.array().cast("array<bigint>")
    for kind in kinds:
        parts = F.col("_inner") if kind > 0 else letters
        own = F.when(F.col("_kind") == kind, _runs(parts, abs(kind))).otherwise(own)
    wanted = passages.select(item_key, "_passage", own.alias("_runs"))
    runs = wanted.select(item_key, F.explode("_runs").alias("digest"))
    bits = table_bits(runs.agg(F.approx_count_distinct("digest")).first()[0])
    # Words and letters are columns of their own, so that a text is cut once and not per shifted copy.
    body = F.col(text)
    split = documents.select(
        document_key,
        F.split(body, SPLIT).alias("_words"),
        (F.filter(F.split(body, ""), lambda c: c != "") if kinds[0] < 0 else F.array().cast("array<string>")).alias("_letters"),
        bit_table(runs.select("digest"), bits).alias("_table"),
    )
    cut = [F.filter(_runs(F.col("_words" if k > 0 else "_letters"), abs(k)), lambda r: passes(r, F.col("_table"), bits)) for k in kinds]
    found = split.select(document_key, F.explode(F.concat(*cut)).alias("digest"))
    # What is left of the texts is small and is needed twice, so it is written once.
    met = reliable_checkpoint(found.join(runs.select("digest").distinct(), "digest", "left_semi"))
    frequency = met.groupBy("digest").agg(F.count(F.lit(1)).alias("texts"))
    counted = runs.join(frequency, "digest", "left").withColumn("texts", F.coalesce("texts", F.lit(0)))
    anchors = counted.groupBy(item_key).agg(F.min(F.struct("texts", "digest")).alias("rarest"))
    anchors = anchors.where("rarest.texts > 0").select(item_key, F.col("rarest.digest").alias("digest"))
    candidates = met.join(anchors, "digest").select(document_key, item_key).distinct()
    verified = candidates.join(documents.select(document_key, body.alias("_text")), document_key)
    # Passages can be long, so the planner chooses this join by their bytes, not by their number.
    verified = verified.join(passages.select(item_key, "_passage"), item_key)
    return verified.filter(F.contains("_text", "_passage")).select(document_key, item_key)
