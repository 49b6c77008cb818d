"""The decision for every packet."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hubflow.functions import is_heartbeat
from hubflow.names import MIB, NAMES, Names
from hubflow.operators import packets as pk
from hubflow.operators.resolve import attach_worker_mode
from hubflow.operators.steps import explode_steps, first_by_key, with_next
from hubflow.operators.transform import apply_transform, definitions

#: Outcomes that end a sender's session.
ERRORS = ("unavailable", "internal", "resource_exhausted")


def run_dimension(runs: DataFrame, pipelines: DataFrame) -> DataFrame:
    """One row per resolved run: namespace, run, pipeline; two strings, however long the pipeline is."""
    known = pipelines.select("namespace", "pipeline").distinct()
    return runs.select("namespace", "run", "pipeline").dropDuplicates(["namespace", "run"]).join(known, ["namespace", "pipeline"], "left_semi")


def step_dimension(steps: DataFrame, workers: DataFrame) -> DataFrame:
    """One row per pipeline and step key: pos, next_step, next_worker, is_job. It grows with the definitions, not with their runs."""
    s = first_by_key(attach_worker_mode(with_next(steps), workers)).where("key IS NOT NULL")
    return s.select("namespace", "pipeline", F.col("key").alias("step_id"), "pos", "next_step", "next_worker", "is_job")


def route(packets: DataFrame, runs: DataFrame, pipelines: DataFrame, workers: DataFrame, *, steps: DataFrame | None = None, names: Names = NAMES, max_inputs: int = MIB) -> DataFrame:
    """R1, R2. Adds outcome, target_step, target_ref, payload (transformed), step_input, inputs_resolved, error.

    First match: unavailable; step_not_found; end_of_pipeline; heartbeat (to the next worker untouched, or
    end_of_worker_chain); internal (the transform failed, even when no worker follows); end_of_worker_chain;
    batch_submitted (internal if the inputs are too long); deliver. What becomes of a ``deliver`` packet is decided by
    its link (see ``buffering``). Every packet gets exactly one outcome.
    """
    steps = explode_steps(pipelines) if steps is None else steps
    # Spark broadcasts either dimension where its size is known to be small enough
    d = packets.join(run_dimension(runs, pipelines), ["namespace", "run"], "left")
    d = d.join(step_dimension(steps, workers), ["namespace", "pipeline", "step_id"], "left").withColumn("resolved", F.col("pipeline").isNotNull())
    hb = is_heartbeat("metadata", names)
    due = ~hb & F.col("next_step").isNotNull() & F.col("next_step.ref").isNull() & F.col("next_step.type").eqNullSafe("transform")
    d = d.withColumns({"transform_with": F.col("next_step.with"), "transform_due": due, "target_with": F.col("next_worker.with"), "heartbeat": hb})
    d = pk.resolve_inputs(pk.check_inputs_size(apply_transform(d, definitions(steps)), max_inputs))
    has_worker = F.col("next_worker").isNotNull()
    outcome = (
        F.when(~F.col("resolved"), "unavailable")
        .when(F.col("pos").isNull(), "step_not_found")
        .when(F.col("next_step").isNull(), "end_of_pipeline")
        .when(F.col("heartbeat"), F.when(has_worker, "heartbeat").otherwise("end_of_worker_chain"))
        .when(F.col("transform_error").isNotNull(), "internal")
        .when(~has_worker, "end_of_worker_chain")
        .when(F.col("is_job"), F.when(F.col("inputs_error").isNotNull(), "internal").otherwise("batch_submitted"))
        .otherwise("deliver")
    )
    d = d.withColumn("outcome", outcome)
    reached = F.col("outcome").isin("heartbeat", "batch_submitted", "deliver")
    d = d.withColumns({
        "target_step": F.when(reached, F.col("next_worker.key")),
        "target_ref": F.when(reached, F.col("next_worker.ref")),
        "payload": F.when(F.col("outcome").isin("deliver", "batch_submitted"), F.col("new_payload")).otherwise(F.col("payload")),
        "error": F.when(F.col("outcome") == "internal", F.coalesce("transform_error", "inputs_error")),
        "step_input": F.when(F.col("outcome") == "batch_submitted", F.col("step_input")),
        "inputs_resolved": F.col("inputs_resolved") & (F.col("outcome") == "batch_submitted"),
    })
    return d.drop("resolved", "pos", "next_step", "next_worker", "is_job", "transform_with", "transform_due", "target_with", "heartbeat", "new_payload", "transform_error", "inputs_error")


def heartbeat_route(routed: DataFrame) -> DataFrame:
    """R2. The heartbeats that reach a worker."""
    return routed.where("outcome = 'heartbeat'")


def fail_stop(outcomes: DataFrame, session: tuple[str, ...] = ("namespace", "run", "step_id"), errors: tuple[str, ...] = ERRORS) -> DataFrame:
    """P4. Adds processed: false for packets that come after an error of their session.

    The first error of a session is an aggregate with partial sums, and Spark can split its join with the packets, so the
    packets of a session never meet in one task. Sessions that begin again are those of ``sessions.run_fates``.
    """
    first = outcomes.where(F.col("outcome").isin(*errors)).groupBy(*session).agg(F.min(F.struct("ts", "seq")).alias("first_error"))
    names = [f"{c}_of_error" for c in session]
    first = first.select(*[F.col(c).alias(n) for c, n in zip(session, names, strict=True)], "first_error")
    same = F.lit(True)
    for c, n in zip(session, names, strict=True):
        same = same & F.col(c).eqNullSafe(F.col(n))
    late = F.struct("ts", "seq") > F.col("first_error")
    return outcomes.join(first, same, "left").withColumn("processed", ~F.coalesce(late, F.lit(False))).drop("first_error", *names)
