"""Allow and block rules for hosts and paths, joined with urls by a sorted sweep.

The canonical key of a host is its labels in reverse, each followed by a point (``com.example.www.``), so a host and
all its subdomains are one interval of keys, and the intervals of two rules are nested or apart. Urls and rules are
dealt out to ranges of (key, path), sorted, and swept once: a stack holds the rules whose interval is open, inner
ones on top, and a url is judged by the longest rule on the stack whose path starts its own path.

The bounds of the ranges come from a bounded hash sample of the urls; they shape the partitions, never the result.
A rule is copied to every range that its interval meets. A url with a third of all rows fills several equal bounds,
and its rows are spread over all ranges between them by a hash.

A null url or one without ``://`` has an empty host and path and matches only a rule without host. Rules with a null
host, path or verdict are ignored. Of rules with the same text, ``block`` wins. Without a rule the verdict is
``default`` and the rule is null. Rows keep their number; repeated rows are judged alike.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import lower_ascii, packed

SAMPLE_ROWS = 8192
LAST = "\U0010ffff"
ALLOW, BLOCK = "allow", "block"
FIELDS = [T.StructField(name, T.StringType()) for name in ("host", "path", "rule", "verdict")]


def url_host(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, "://([^/?#]*)", 1)), F.lit(""))


def url_path(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, "://[^/?#]*([^?#]*)", 1), F.lit(""))


def host_key(host: Column) -> Column:
    """Reversed labels, each closed by a point; empty for an empty host."""
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


class Open:
    """The rules of one host: by path, with the path lengths that occur."""

    def __init__(self, key: str):
        self.key = key
        self.rules: dict[str, tuple[str, str]] = {}
        self.lengths: list[int] = []

    def add(self, path: str, rule: str, verdict: str) -> None:
        if self.rules.get(path, ("", ALLOW))[1] != BLOCK:
            self.rules[path] = (rule, verdict)
        if len(path) not in self.lengths:
            self.lengths = sorted([*self.lengths, len(path)], reverse=True)

    def longest(self, path: str) -> tuple[str, str] | None:
        return next((hit for n in self.lengths if n <= len(path) and (hit := self.rules.get(path[:n]))), None)


class Sweep:
    """Rules and urls in order of the key, rules first; the stack holds the hosts whose interval is open."""

    def __init__(self, default: str):
        self.default, self.part, self.stack = default, None, []

    def at(self, part: int, key: str) -> list[Open]:
        if part != self.part:
            self.part, self.stack = part, []
        while self.stack and not key.startswith(self.stack[-1].key):
            self.stack.pop()
        return self.stack

    def open(self, part: int, key: str, path: str, rule: str, verdict: str) -> None:
        stack = self.at(part, key)
        if not stack or stack[-1].key != key:
            stack.append(Open(key))
        stack[-1].add(path, rule, verdict)

    def judge(self, part: int, key: str, path: str) -> tuple[str | None, str]:
        hits = [hit for entry in reversed(self.at(part, key)) if (hit := entry.longest(path))]
        return max(hits, key=lambda hit: len(hit[0])) if hits else (None, self.default)


def range_bounds(keyed: DataFrame, parts: int) -> list[tuple[str, str]]:
    """``parts`` - 1 bounds at even places of a bounded sample, which a hash of the row chooses.

    A limit on the hash that about twice the sample passes keeps the others from leaving their task.
    """
    share = min(1.0, 2 * SAMPLE_ROWS / max(1, keyed.count()))
    likely = keyed.select("key", "path", "draw").where(F.col("draw") <= int((share - 0.5) * (2**64 - 2048)))
    rows = likely.orderBy("draw").limit(SAMPLE_ROWS).collect()
    drawn = sorted((row["key"], row["path"]) for row in rows)
    return [drawn[i * len(drawn) // parts] for i in range(1, parts)] if drawn else []


def judge_urls(
    pages: DataFrame,
    rules: DataFrame,
    keep: list[str],
    url: str = "url",
    host: str = "host",
    path: str = "path",
    verdict: str = "verdict",
    default: str = ALLOW,
    parts: int | None = None,
) -> DataFrame:
    """Pages as ``row`` (the kept columns), with ``host``, ``path``, the winning ``rule`` and the ``verdict``."""
    parts = parts or int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    address = F.col(url).cast("string")
    keyed = pages.select(packed(pages, keep), address.alias("address"))
    keyed = keyed.select("row", url_host(F.col("address")).alias("host"), url_path(F.col("address")).alias("path"), "address")
    keyed = keyed.withColumns({"key": host_key(F.col("host")), "draw": F.xxhash64("address", F.col("row"))}).drop("address")
    bounds = range_bounds(keyed, parts)

    @F.pandas_udf("int")
    def page_part(key: pd.Series, path: pd.Series, draw: pd.Series) -> pd.Series:
        out = []
        for at, spread in zip(zip(key, path, strict=True), draw, strict=True):
            low, high = bisect_left(bounds, at), bisect_right(bounds, at)
            out.append(low + spread % (high - low + 1))
        return pd.Series(out, dtype="int32")

    @F.pandas_udf("array<int>")
    def rule_parts(key: pd.Series) -> pd.Series:
        return pd.Series([list(range(bisect_left(bounds, (k, "")), bisect_right(bounds, (k + LAST, "")) + 1)) for k in key])

    own = [F.col(host).cast("string").alias("host"), F.col(path).cast("string").alias("path"), F.col(verdict).cast("string").alias("verdict")]
    known = rules.select(*own).dropna().dropDuplicates()
    known = known.withColumn("key", host_key(lower_ascii(F.col("host"))))
    kind = keyed.schema["row"].dataType
    sides = [
        keyed.select(
            page_part("key", "path", "draw").alias("part"), "key", F.lit(1).alias("kind"), "path", "host",
            F.lit(None).cast("string").alias("verdict"), "row",
        ),
        known.select(
            F.explode(rule_parts("key")).alias("part"), "key", F.lit(0).alias("kind"), "path", "host", "verdict",
            F.lit(None).cast(kind).alias("row"),
        ),
    ]
    dealt = sides[0].unionByName(sides[1]).repartition(parts, "part").sortWithinPartitions("part", "key", "kind", "path")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Sweep(default)
        for batch in batches:
            at, found, marks = [], {"rule": [], "verdict": []}, batch.column("kind").to_pylist()
            names = ("part", "key", "path", "host", "verdict")
            for i, (part, key, path, host, verdict) in enumerate(zip(*[batch.column(n).to_pylist() for n in names], strict=True)):
                if marks[i]:
                    rule, said = state.judge(part, key, path)
                    at.append(i)
                    found["rule"].append(rule)
                    found["verdict"].append(said)
                else:
                    state.open(part, key, path, host + path, verdict)
            pages = batch.select(["row", "host", "path"]).take(pa.array(at, pa.int64()))
            made = [pa.array(found[name], pa.string()) for name in ("rule", "verdict")]
            yield pa.RecordBatch.from_arrays([*pages.columns, *made], names=["row", *[f.name for f in FIELDS]])

    return dealt.mapInArrow(sweep, T.StructType([dealt.schema["row"], *FIELDS]))
