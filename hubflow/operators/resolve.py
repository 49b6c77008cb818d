"""Joins of packets with runs, pipelines, steps and workers.

No side is broadcast by hint: dimension tables may grow with the number of pipelines and runs. Spark broadcasts a side
by itself where its size is known to be below ``spark.sql.autoBroadcastJoinThreshold``, and shuffles otherwise.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.operators.steps import first_by_key


def attach_pipeline(packets: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """J1. Adds pipeline and resolved: packet to run by (namespace, run), run to pipeline in the run's namespace.

    Runs and pipelines meet first, on the small side, so packets are shuffled once at most.
    """
    known = pipelines.select("namespace", "pipeline").distinct()
    of = runs.select("namespace", "run", "pipeline").join(known, ["namespace", "pipeline"]).dropDuplicates(["namespace", "run"])
    return packets.join(of, ["namespace", "run"], "left").withColumn("resolved", F.col("pipeline").isNotNull())


def unresolved_packets(packets: DataFrame, runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """J2. Packets whose run or pipeline is missing."""
    of = runs.select("namespace", "run", "pipeline").join(pipelines.select("namespace", "pipeline"), ["namespace", "pipeline"], "left_semi")
    return packets.join(of, ["namespace", "run"], "left_anti")


def locate_step(packets: DataFrame, steps: DataFrame) -> DataFrame:
    """J3. Adds the columns of the first step whose key is the packet's step_id: pos, next_step, next_worker; null if none is."""
    s = first_by_key(steps).select("namespace", "pipeline", F.col("key").alias("step_id"), "pos", *[c for c in ("next_step", "next_worker") if c in steps.columns])
    return packets.join(s, ["namespace", "pipeline", "step_id"], "left")


def attach_worker_mode(df: DataFrame, workers: DataFrame, ref: str = "next_worker.ref") -> DataFrame:
    """J4. Adds is_job: the next worker is known and in job mode; an unknown worker streams."""
    jobs = workers.where("mode = 'job'").select("namespace", F.col("worker").alias("job_ref")).distinct()
    d, j = df.alias("d"), jobs.alias("j")
    on = (F.col("d.namespace") == F.col("j.namespace")) & (F.col(f"d.{ref}") == F.col("j.job_ref"))
    return d.join(j, on, "left").select("d.*", F.col("j.job_ref").isNotNull().alias("is_job"))
