"""Intermediate tables in the checkpoint folder, and joins that are planned by their sizes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

#: Rows of a task where rows are dealt out by their number.
A_SHARE = 1_000_000


def _checkpoint_folder(spark: SparkSession) -> str:
    """The checkpoint folder of the cluster; a temporary one only for a local session that has none."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        named = spark.conf.get("spark.checkpoint.dir", None)
        if named is None and not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        context.setCheckpointDir(named or tempfile.mkdtemp(prefix="gasflow-checkpoint-"))
    return context.getCheckpointDir()


def materialize(df: DataFrame) -> DataFrame:
    """Write the frame to the checkpoint folder as a table and read it from there.

    Parquet keeps the columns apart and reports its size, so later plans prune and broadcast by it.
    """
    path = scratch_folder(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread_out(df: DataFrame) -> DataFrame:
    """Deal rows out evenly before heavy work on them, when the files they come from would fill fewer partitions than there are cores."""
    spark = df.sparkSession
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    held = sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))
    cores = spark.sparkContext.defaultParallelism
    a_partition = int(spark._jsparkSession.sessionState().conf().filesMaxPartitionBytes())
    return df.repartition(cores) if held < cores * a_partition else df


def dealt_out(df: DataFrame, rows: int, *keys: str) -> DataFrame:
    """Rows dealt out by key to as many tasks as ``rows`` need, so that what a task holds does not grow with them.

    Meant for keys that few rows share each; no rows are combined before.
    """
    least = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(max(least, -(-rows // A_SHARE)), *keys)


def scratch_folder(spark: SparkSession, name: str) -> str:
    """A new path inside the checkpoint folder."""
    return f"{_checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"


def lookup_join(df: DataFrame, lookup: DataFrame, on: str | Sequence[str], how: str = "left") -> DataFrame:
    """Join a table to a lookup that is written out first, so that the planner knows its bytes.

    Up to ``spark.sql.autoBroadcastJoinThreshold`` it is broadcast and the table stays where it is; beyond that the join
    shuffles, and adaptive execution splits the partitions of hot keys.
    """
    return df.join(materialize(lookup), [on] if isinstance(on, str) else list(on), how)
