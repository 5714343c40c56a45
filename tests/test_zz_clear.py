"""Runs last: removes the session's working tables."""

import pytest
from pyspark.errors import AnalysisException

from blockwalk import from_edges, runtime


def test_clear(spark):
    graph = from_edges(spark, [(1, 2), (2, 3)])
    name = graph.links("out").cold.work_table
    assert spark.table(name).count() == 2
    runtime.clear(spark)
    with pytest.raises(AnalysisException):
        spark.table(name)
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(runtime.work_root(spark))
    assert not root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(root)
    # the next table starts a new folder
    assert runtime.cut(graph.edges).count() == 2
