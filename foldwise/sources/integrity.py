"""Digest and size of files against a manifest."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce
from urllib.parse import unquote

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import ContractViolation
from ..session import collect_small

VALUE_BYTES = 1 << 26  # larger files are hashed piece by piece
MAX_VALUE_BYTES = 2**31 - 1  # Spark's limit for one value
MARK = b"\xef\xbb\xbf"  # Spark's reader of lines takes this off the front of a file


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of a batch that follow each other in a block of a file as one value, numbered within the block."""
    last, number = None, 0
    for batch in batches:
        if not batch.num_rows:
            continue
        block = batch.column("block").to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
        lines = batch.column("line").cast(pa.large_binary())
        ends = np.frombuffer(lines.buffers()[1], np.int64)[lines.offset :]
        firsts, numbers, pieces = edges[:-1], [], []
        for at, end in zip(firsts.tolist(), edges[1:].tolist()):
            number = number + 1 if block[at] == last else 0
            last = block[at]
            numbers.append(number)
            pieces.append(lines.buffers()[2].slice(int(ends[at]), int(ends[end] - ends[at])).to_pybytes())
        kept = [batch.column(name).take(pa.array(firsts)) for name in ("path", "bytes", "start")]
        columns = [*kept, pa.array(numbers, pa.int64()), pa.array(pieces, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["path", "bytes", "start", "number", "piece"])


class Chain:
    """SHA-256 of a file from its lines, each with a line feed behind it; the last byte waits until the end is known."""

    def __init__(self, path: str, size: int):
        self.path, self.size, self.seen, self.waits = path, size, 0, b""
        self.plain, self.marked = hashlib.sha256(), hashlib.sha256(MARK)

    def add(self, piece: bytes) -> None:
        for part in (self.waits, memoryview(piece)[:-1]):
            self.plain.update(part)
            self.marked.update(part)
        self.seen, self.waits = self.seen + len(piece), piece[-1:]

    def row(self) -> tuple[str, str, int]:
        """The size tells whether a mark was taken off, and whether the last line has its line feed in the file."""
        gone = self.size - self.seen
        if gone not in (-1, 0, 2, 3):
            raise ContractViolation(f"{self.path} has {self.size} bytes and its lines {self.seen}: it changed while it was read")
        digest = self.marked if gone > 0 else self.plain
        if gone in (0, 3):
            digest.update(self.waits)
        return unquote(self.path), digest.hexdigest(), self.size


def _chains(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def given(chain: Chain) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([value]) for value in chain.row()], names=["path", "sha256", "bytes"])

    chain = None
    for batch in batches:
        paths, sizes, pieces = (batch.column(name) for name in ("path", "bytes", "piece"))
        for at in range(batch.num_rows):
            path = paths[at].as_py()
            if chain is None or chain.path != path:
                if chain is not None:
                    yield given(chain)
                chain = Chain(path, sizes[at].as_py())
            chain.add(pieces[at].as_py())
    if chain is not None:
        yield given(chain)


def _streamed_digests(lines: DataFrame) -> DataFrame:
    """(path, sha256, bytes) of the files of a text source: their blocks are read anywhere, and each file is one chain.

    A task of a chain holds one piece at a time. A piece is whole lines, so only a stretch without any line feed can be long.
    """
    pieces = lines.select(
        F.col("_metadata.file_path").alias("path"),
        F.col("_metadata.file_size").alias("bytes"),
        F.col("_metadata.file_block_start").alias("start"),
        F.xxhash64("_metadata.file_path", "_metadata.file_block_start").alias("block"),
        F.concat("value", F.lit("\n")).cast("binary").alias("line"),
    ).mapInArrow(_pieces, "path string, bytes long, start long, number long, piece binary")
    dealt = pieces.repartition("path").sortWithinPartitions("path", "start", "number")
    return dealt.mapInArrow(_chains, "path string, sha256 string, bytes long")


def file_digests(spark: SparkSession, path: str, pattern: str = "*", value_bytes: int = VALUE_BYTES) -> DataFrame:
    """name (path below the folder), sha256 and bytes of every file.

    A file of up to ``value_bytes`` is one value, hashed where it is read. The SHA-256 of a larger one is one chain over
    its bytes, which no two tasks can share: its blocks are read in parallel and meet in one task, in order. Spark's reader
    of lines would unpack files named like compressed ones, so these are one value at any size, and refused over 2 GiB.
    """

    def source(kind: str) -> DataFrame:
        reader = spark.read.format(kind).option("pathGlobFilter", pattern).option("recursiveFileLookup", True)
        return reader.option("lineSep", "\n").load(path)

    def hashed(files: DataFrame) -> DataFrame:
        return files.select("path", F.sha2("content", 256).alias("sha256"), F.col("length").alias("bytes"))

    jvm, files = spark._jvm, source("binaryFile")
    found = hashed(files.where(F.col("length") <= value_bytes))
    # Listing without the content column reads no bytes.
    suffix = F.regexp_extract("path", r"(\.[^./]+)?$", 0).alias("suffix")
    large = files.where(F.col("length") > value_bytes).groupBy(suffix).agg(F.max("length").alias("most"))
    large = collect_small(large, what="list of suffixes")
    codecs = jvm.org.apache.hadoop.io.compress.CompressionCodecFactory(spark._jsc.hadoopConfiguration())
    packed = [row for row in large if codecs.getCodec(jvm.org.apache.hadoop.fs.Path(f"x{row['suffix']}")) is not None]
    if refused := [row["suffix"] for row in packed if row["most"] > MAX_VALUE_BYTES]:
        raise ContractViolation(f"compressed files too large for one binary value; fingerprint their rows instead: {refused}")
    is_packed = reduce(lambda a, row: a | F.col("_metadata.file_name").endswith(row["suffix"]), packed, F.lit(False))
    is_large = F.col("_metadata.file_size") > value_bytes
    if packed:
        found = found.unionAll(hashed(files.where(is_large & is_packed)))
    if len(large) > len(packed):
        found = found.unionAll(_streamed_digests(source("text").where(is_large & ~is_packed)))
    # paths come back with a scheme in front, so the folder is cut off at its own, absolute path
    root = jvm.org.apache.hadoop.fs.Path(path).toUri().getPath().rstrip("/") + "/"
    return found.select(F.substring_index("path", root, -1).alias("name"), "sha256", "bytes")


def file_integrity(spark: SparkSession, path: str, manifest: DataFrame, pattern: str = "*") -> DataFrame:
    """Files that are missing, undeclared, or differ in digest or size: name, status."""
    found = file_digests(spark, path, pattern).select("name", F.struct("sha256", "bytes").alias("_f"))
    declared = manifest.select("name", F.struct("sha256", "bytes").alias("_m"))
    status = (
        F.when(F.col("_f").isNull(), F.lit("missing"))
        .when(F.col("_m").isNull(), F.lit("undeclared"))
        .when(F.col("_f.sha256") != F.col("_m.sha256"), F.lit("digest"))
        .when(F.col("_f.bytes") != F.col("_m.bytes"), F.lit("size"))
    )
    joined = declared.join(found, "name", "full_outer").withColumn("status", status)
    return joined.filter(F.col("status").isNotNull()).select("name", "status")
