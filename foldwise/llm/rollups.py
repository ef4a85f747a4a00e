"""Token totals by source, language and tokenizer version, kept up to date by signed deltas.

A change is a signed count: an insert adds a document and its tokens, a delete takes them away, a revised count does
both, possibly under another tokenizer version. Changes of a batch are summed before anything is written, so a batch is
a few rows per key however large it is, and a source with a third of all documents is summed in every task first.

A batch is committed as one folder under its id. The marker that Spark's writer leaves at the end makes it count: a
batch that is committed already is not applied again, and what an interrupted run left without the marker is written
anew. Totals are the sum over all committed batches; the order of batches does not matter.

Null sources, languages and versions are keys like any other. A null count is an error of the caller and counts 0
tokens. An empty batch is committed with no rows. Totals of an empty rollup have no rows; keys whose documents and
tokens have come back to zero are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

KEYS = ["source", "lang", "version"]
SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"
MARKER = "_SUCCESS"


def signed(rows: DataFrame, sign: int, version: str | Column, tokens: str | Column) -> DataFrame:
    """Changes of documents (with ``source`` and ``lang``) counted by one tokenizer version: +1 inserts, -1 deletes."""
    named = F.lit(version) if isinstance(version, str) else version
    count = F.coalesce(F.col(tokens) if isinstance(tokens, str) else tokens, F.lit(0)).cast("bigint")
    return rows.select(
        F.col("source").cast("string").alias("source"),
        F.col("lang").cast("string").alias("lang"),
        named.cast("string").alias("version"),
        F.lit(sign).cast("bigint").alias("n_docs"),
        (count * sign).alias("n_tokens"),
    )


def revised(rows: DataFrame, old: tuple, new: tuple) -> DataFrame:
    """Changes of documents whose count under (version, tokens) ``old`` is replaced by ``new``."""
    return signed(rows, -1, *old).unionAll(signed(rows, 1, *new))


def summed(changes: DataFrame) -> DataFrame:
    return changes.groupBy(*KEYS).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))


class Rollup:
    """Totals under a folder that driver and executors share."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _path(self, *names: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path("/".join([self.folder, *names]))

    def _files(self):
        return self._path().getFileSystem(self.spark._jsc.hadoopConfiguration())

    def committed(self) -> list[str]:
        """Ids of the batches that count."""
        files = self._files()
        if not files.exists(self._path()):
            return []
        names = [status.getPath().getName() for status in files.listStatus(self._path())]
        return sorted(name.removeprefix("batch-") for name in names if name.startswith("batch-") and files.exists(self._path(name, MARKER)))

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Apply a batch once; False if it was committed before."""
        if not batch or "/" in batch:
            raise ValueError("a batch id is a text without a slash")
        if self._files().exists(self._path(f"batch-{batch}", MARKER)):
            return False
        summed(changes).where("n_docs <> 0 or n_tokens <> 0").write.mode("overwrite").parquet(f"{self.folder}/batch-{batch}")
        return True

    def totals(self) -> DataFrame:
        batches = [f"{self.folder}/batch-{name}" for name in self.committed()]
        rows = self.spark.read.schema(SCHEMA).parquet(*batches) if batches else self.spark.createDataFrame([], SCHEMA)
        return summed(rows).where("n_docs <> 0 or n_tokens <> 0")
