"""Sources and sinks of packets."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow import schema
from hubflow.functions import step_run_name
from hubflow.names import NAMES, Names

#: Outcomes that are neither a delivery nor a silent end.
DEAD = ("unavailable", "internal", "resource_exhausted", "oversize", "buffer_full", "invalid", "late", "evicted")


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder under the shared one that the cluster names; a folder of this machine only where Spark runs on it alone."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if base is None:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-")
    return f"{base}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """The same rows, written as Parquet to a ``scratch`` folder and read from there, with their lineage cut; the files go when the driver ends."""
    spark, path = df.sparkSession, scratch(df.sparkSession, name)
    df.write.parquet(path)
    files = spark._jvm.org.apache.hadoop.fs.Path(path)
    files.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(files)
    return spark.read.schema(df.schema).parquet(path)


def read_packets(spark: SparkSession, path: str, *, streaming: bool = False, fmt: str = "parquet", layout: str = schema.PACKETS, **options: str) -> DataFrame:
    """S1. Scans packets in the envelope schema; a stream ends when its source does (``availableNow``)."""
    reader = spark.readStream if streaming else spark.read
    return reader.format(fmt).schema(layout).options(**options).load(path)


def unwrap_packets(df: DataFrame, packet: str = "packet") -> DataFrame:
    """S2. Drops empty envelopes and exposes the packet's fields."""
    return df.where(F.col(packet).isNotNull()).select(f"{packet}.*")


def write_routed(df: DataFrame, path: str, *, checkpoint: str | None = None, trigger: dict | None = None, by: tuple[str, ...] = ("outcome",)):
    """S3. Writes routed packets as Parquet, folders by outcome; ts and seq keep the order within a link.

    The link itself is a column, not a folder: there are as many links as runs and steps. A streaming frame needs a
    ``checkpoint`` and gives a started query.
    """
    if df.isStreaming:
        return df.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).partitionBy(*by).outputMode("append").trigger(**(trigger or {"availableNow": True})).start()
    return df.write.mode("append").partitionBy(*by).parquet(path)


def build_step_runs(routed: DataFrame, names: Names = NAMES) -> DataFrame:
    """S4. One request row for every packet that reached a job-mode worker (outcome ``batch_submitted``)."""
    p = names.label_prefix
    labels = F.create_map(F.lit(f"{p}storyrun"), F.col("run"), F.lit(f"{p}story-name"), F.col("pipeline"), F.lit(f"{p}hybrid"), F.lit("true"))
    upstream = F.create_map(F.lit(f"{p}upstream-step"), F.col("step_id"))
    resolved = F.create_map(F.lit(f"{p}inputs-resolved"), F.lit("true"))
    return routed.where("outcome = 'batch_submitted'").select(
        "namespace", step_run_name("run", "target_step", "ts").alias("name"), labels.alias("labels"),
        F.when(F.col("inputs_resolved"), F.map_concat(upstream, resolved)).otherwise(upstream).alias("annotations"),
        "run", F.col("target_step").alias("step_id"), F.col("target_ref").alias("ref"), F.col("step_input").alias("input"),
    )


def dead_letters(routed: DataFrame, outcomes: tuple[str, ...] = DEAD) -> DataFrame:
    """S5. Packets that were dropped or refused."""
    return routed.where(F.col("outcome").isin(*outcomes))


def write_two_sinks(df: DataFrame, path: str, dead_path: str, *, checkpoint: str, outcomes: tuple[str, ...] = DEAD, trigger: dict | None = None):
    """S3 and S5 over a stream: dead letters to one folder, all other packets to another, from one pass; gives a started query.

    Each micro-batch has a folder of its own in both places (``batch_no=...``), which is replaced as a whole. So a batch
    that failed between its two sinks and is run again writes nothing twice.
    """

    def both(batch: DataFrame, number: int) -> None:
        kept = batch.persist()
        try:
            dead = F.coalesce(F.col("outcome").isin(*outcomes), F.lit(False))
            for where, rows in ((dead_path, kept.where(dead)), (path, kept.where(~dead))):
                rows.write.mode("overwrite").parquet(f"{where}/batch_no={number}")
        finally:
            kept.unpersist()

    return df.writeStream.foreachBatch(both).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()
