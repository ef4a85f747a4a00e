import os

import pytest
from pyspark.sql import SparkSession


@pytest.fixture(scope="session", autouse=True)
def checkpoints(spark, tmp_path_factory):
    """Tests have no cluster that names a shared folder, so they name one."""
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("checkpoints")))


@pytest.fixture()
def table(spark: SparkSession):
    """A table from rows and a schema text."""
    return lambda rows, schema: spark.createDataFrame(rows, schema)


def brute_roots(nodes, linked):
    """Smallest member of each node's component, by plain search over all pairs."""
    roots = {node: node for node in nodes}

    def find(node):
        while roots[node] != node:
            node = roots[node]
        return node

    for a in nodes:
        for b in nodes:
            if a < b and linked(a, b):
                x, y = find(a), find(b)
                roots[max(x, y)] = min(x, y)
    return {node: find(node) for node in nodes}


DATA = os.environ.get("LLM_TEST_DATA", "/root/testdata/sf0.001")
