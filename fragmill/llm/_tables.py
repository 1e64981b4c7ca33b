"""Intermediate tables in the folder that all executors share, and components of a graph of links."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fragmill.session import ensure_checkpoint_dir


BATCH, BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch", 4 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written(df: DataFrame) -> DataFrame:
    """The rows of df as a table in spark.checkpoint.dir: cuts lineage, survives lost executors."""
    spark: SparkSession = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # the write's own shuffle files go when it is done
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def unused(df: DataFrame, name: str) -> str:
    """A column name like the given one that df doesn't have in any spelling."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def dropped(*tables: DataFrame) -> None:
    """Deletes tables of ``written`` that nothing reads any more, through Spark's own file systems."""
    for df in tables:
        files = df.inputFiles()
        folder = files[0].rpartition("/")[0] if files else ""
        if folder.rpartition("/")[2].startswith("table-"):
            jvm = df.sparkSession.sparkContext._jvm
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def bounded(spark: SparkSession) -> SparkSession:
    """Bounds the batches that go to Python by bytes, as rows of text have any length; a lower bound stays."""
    if spark.sparkContext._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(spark.conf.get(BATCH, "64m")) > BATCH_BYTES:
        spark.conf.set(BATCH, str(BATCH_BYTES))
    return spark


def components(links: DataFrame) -> DataFrame:
    """(node, component) for every node of links (a, b); component: the least node that it reaches.

    Each round takes the least label among neighbours and then the label of that label, so that rounds grow
    with the logarithm of a chain's length. Labels stay in Spark."""
    both = written(links.select("a", "b").union(links.select("b", "a")).toDF("node", "other").distinct())
    labels = written(both.groupBy("node").agg(F.least(F.min("other"), F.first("node")).alias("label")))
    while True:
        near = both.join(labels.withColumnRenamed("node", "other"), "other").groupBy("node").agg(F.min("label").alias("near"))
        step = labels.join(near, "node").select("node", F.least("label", "near").alias("label"), F.col("label").alias("was"))
        step = written(step)
        old = labels
        jump = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = written(step.join(jump, "label").select("node", F.least("label", "next").alias("label"), "was"))
        changed = new.where("label <> was").limit(1).count()
        labels = new.drop("was")
        dropped(old, step)
        if not changed:
            dropped(both)
            return labels.select("node", F.col("label").alias("component"))
