"""Working tables: cutting lineage inside loops without losing work on executor failure.

Loops over DataFrames re-plan everything since the last materialisation. ``cut`` writes the
frame as parquet below the shared checkpoint folder and reads it back, so the next round
starts from a durable, column-pruned scan with real size statistics. Nothing here depends on
executor-local blocks, so the shuffle files behind a table go when it is written, not when the
driver happens to collect its garbage.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_CONF = "spark.checkpoint.dir"
# a query that starts under it deletes its shuffle files when it has ended
SHUFFLES_END_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"

# rows one bucket of a co-partitioned edge table should hold
ROWS_PER_BUCKET = 4_000_000
MIN_ROWS_PER_BUCKET = 10_000
MAX_BUCKETS = 50_000
# rows one task of a sorting stage should hold
ROWS_PER_TASK = 1_000_000


def work_root(spark: SparkSession) -> str:
    """Folder for working tables: the cluster's checkpoint folder, or a local one on local[*]."""
    sc = spark.sparkContext
    root = spark.conf.get(CHECKPOINT_CONF, None) or sc.getCheckpointDir()
    if not root:
        if sc.master != "local" and not sc.master.startswith("local["):
            raise RuntimeError(f"set {CHECKPOINT_CONF} to a folder every executor can reach")
        root = tempfile.mkdtemp(prefix="blockwalk-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    return f"{root.rstrip('/')}/blockwalk/{sc.applicationId}"


def _table_prefix(spark: SparkSession) -> str:
    """Catalog names of this application's bucketed tables start with this."""
    return "blockwalk_" + re.sub(r"\W", "_", spark.sparkContext.applicationId).lower()


@contextmanager
def shuffles_end(spark: SparkSession) -> Iterator[None]:
    """Queries that start inside delete their shuffle files as soon as they have ended."""
    before = spark.conf.get(SHUFFLES_END_CONF, None)
    spark.conf.set(SHUFFLES_END_CONF, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(SHUFFLES_END_CONF)
        else:
            spark.conf.set(SHUFFLES_END_CONF, before)


def cut(df: DataFrame) -> DataFrame:
    """Materialise ``df`` as a parquet working table and return a frame reading it."""
    spark = df.sparkSession
    path = f"{work_root(spark)}/{uuid.uuid4().hex}"
    with shuffles_end(spark):
        df.write.parquet(path)
    table = spark.read.schema(df.schema).parquet(path)
    table.work_path = path
    return table


def settled(df: DataFrame) -> DataFrame:
    """``df`` itself if it is a working table, else cut: for inputs that are read repeatedly."""
    return df if getattr(df, "work_path", None) else cut(df)


def bucket_count(spark: SparkSession, rows: int) -> int:
    """Buckets for a table of ``rows`` rows: enough for every core, few enough to stay full."""
    by_size = -(-rows // ROWS_PER_BUCKET)
    by_cores = min(spark.sparkContext.defaultParallelism, -(-rows // MIN_ROWS_PER_BUCKET))
    return int(max(1, min(MAX_BUCKETS, max(by_size, by_cores))))


def by_rows(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """``df``, of ``rows`` rows, dealt by ``keys`` to as many tasks as hold ``ROWS_PER_TASK`` each; small
    tables stay as they are. Joins and groupings on the keys need no further exchange."""
    return df if rows <= ROWS_PER_TASK else df.repartition(-(-rows // ROWS_PER_TASK), *keys)


def cut_bucketed(df: DataFrame, keys: list[str], buckets: int, inside=None) -> DataFrame:
    """Materialise ``df`` bucketed and sorted on ``keys``: later joins and aggregates on those
    keys need no exchange of this side. ``inside`` is applied to the rows dealt by ``keys``: windows
    over the keys need no exchange of their own there."""
    spark = df.sparkSession
    name = f"{_table_prefix(spark)}_{uuid.uuid4().hex}"
    path = f"{work_root(spark)}/{name}"
    dealt = df.repartition(buckets, *keys)
    dealt = dealt if inside is None else inside(dealt)
    with shuffles_end(spark):
        (
            dealt.write.bucketBy(buckets, *keys)
            .sortBy(*keys)
            .option("path", path)
            .format("parquet")
            .saveAsTable(name)
        )
    table = spark.table(name)
    table.work_path = path
    table.work_table = name
    return table


def release(table: DataFrame | None) -> None:
    """Delete a working table made by ``cut`` or ``cut_bucketed``; other frames are ignored.
    Only call it when no live frame still reads the table."""
    path = getattr(table, "work_path", None)
    if path is None:
        return
    spark = table.sparkSession
    name = getattr(table, "work_table", None)
    if name:
        spark.sql(f"DROP TABLE IF EXISTS {name}")
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)


def clear(spark: SparkSession) -> None:
    """Delete all working tables of this application; frames that read them stop working."""
    for row in spark.sql(f"SHOW TABLES LIKE '{_table_prefix(spark)}_*'").collect():
        spark.sql(f"DROP TABLE IF EXISTS {row['tableName']}")
    root = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(work_root(spark))
    root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(root, True)


def iterate(state: DataFrame, step, rounds: int | None, done=None, cut_every: int = 1):
    """Run ``state = step(state, i)`` for i = 1..rounds (or until ``done(state)`` when None).

    The state is cut every ``cut_every`` rounds; tables of earlier rounds are deleted as soon
    as the next cut exists. ``done`` is evaluated on cut states only.
    """
    i = 0
    held = None
    while rounds is None or i < rounds:
        i += 1
        state = step(state, i)
        if i % cut_every == 0 or i == rounds:
            state = cut(state)
            release(held)
            held = state
            if done is not None and done(state):
                break
    return state
