"""Pipelines as tables of steps, and what follows each step."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.functions import step_key

KEY = ["namespace", "pipeline"]
STEP_FIELDS = ("id", "name", "ref", "type", "with")


def explode_steps(pipelines: DataFrame) -> DataFrame:
    """P1. One row per step with its position (from 0) and key; pipelines without steps give none."""
    return pipelines.select(*KEY, F.posexplode("steps").alias("pos", "step")).select(*KEY, "pos", "step.*").withColumn("key", step_key())


def worker_steps(steps: DataFrame) -> DataFrame:
    """F4."""
    return steps.where(F.col("ref").isNotNull())


def with_next(steps: DataFrame) -> DataFrame:
    """P2 and P3. Adds next_step, the step right after, and next_worker, the first step after that has a ref (null: none).

    Both look backwards over the steps in descending order, so a pipeline of any length takes one step a row.
    """
    w = Window.partitionBy(*KEY).orderBy(F.desc("pos"))
    this = F.struct("pos", "key", *STEP_FIELDS)
    after = w.rowsBetween(Window.unboundedPreceding, -1)
    return steps.withColumns({"next_step": F.lag(this).over(w), "next_worker": F.last(F.when(F.col("ref").isNotNull(), this), ignorenulls=True).over(after)})


def next_step(steps: DataFrame) -> DataFrame:
    """P2."""
    return with_next(steps).drop("next_worker")


def next_worker_step(steps: DataFrame) -> DataFrame:
    """P3."""
    return with_next(steps).drop("next_step")


def first_by_key(steps: DataFrame) -> DataFrame:
    """The first step of each key within its pipeline, so that a join on keys never repeats a packet (see ``locate_step``)."""
    rest = [c for c in steps.columns if c not in (*KEY, "key")]
    return steps.groupBy(*KEY, "key").agg(F.min_by(F.struct(*rest), "pos").alias("s")).select(*KEY, "key", "s.*")
