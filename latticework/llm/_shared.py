"""Intermediate tables in the folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The cluster's checkpoint folder; a local one only where none is set, as in tests."""
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        shared = context.getConf().get("spark.checkpoint.dir")
        if not shared and not context.master.startswith("local"):
            raise ValueError("on a cluster, spark.checkpoint.dir must name a folder that all machines share")
        context.setCheckpointDir(shared or tempfile.mkdtemp(prefix="checkpoints-"))
    return context.getCheckpointDir()


#: Rows of an Arrow batch of texts; Spark's own number of rows makes batches of tens of MB, several at a time in each task.
BATCH_KEY, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 512


def bounded(docs: DataFrame) -> DataFrame:
    """``docs``, in a session whose Arrow batches hold few texts; a number that the cluster or caller has chosen stays."""
    conf = docs.sparkSession.conf
    if int(conf.get(BATCH_KEY)) == 10_000:
        conf.set(BATCH_KEY, str(BATCH_ROWS))
    return docs


def kept(table: DataFrame) -> DataFrame:
    """The table, written to the shared folder and read again: lineage ends here, and a lost executor costs nothing."""
    path = f"{folder(table.sparkSession)}/{uuid.uuid4()}"
    table.write.parquet(path)
    return table.sparkSession.read.schema(table.schema).parquet(path)
