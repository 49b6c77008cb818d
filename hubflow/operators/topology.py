"""Connections between consecutive workers, and how they differ from what runs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.functions import hub_host, is_hub_primitive, service_host
from hubflow.names import DOWNSTREAM, HUB_PRIMITIVES, NAMES, UPSTREAM, Names
from hubflow.operators.steps import KEY, explode_steps

#: Strategy of one worker set per run, connection kinds.
PER_RUN, HUB, DIRECT = "PerStoryRun", "HubAndSpoke", "PeerToPeer"


def streaming_runs(runs: DataFrame, pipelines: DataFrame, pattern: str = "streaming") -> DataFrame:
    """F5. Runs of pipelines with the streaming pattern, with phase active or deleting; others are ignored."""
    p = pipelines.where(F.col("pattern") == pattern).select(*KEY, "strategy")
    return runs.join(p, KEY).withColumn("phase", F.when(F.col("deleted_at").isNotNull(), "deleting").otherwise("active"))


def pick_transport(pipelines: DataFrame, names: Names = NAMES, default: str = "grpc") -> DataFrame:
    """F6. Adds transport: the annotation where its key exists, even empty; else the default."""
    a = F.col("annotations")
    has = F.coalesce(F.map_contains_key(a, names.transport), F.lit(False))
    return pipelines.withColumn("transport", F.when(has, a[names.transport]).otherwise(default))


def unknown_transports(pipelines: DataFrame, registry: tuple[str, ...] = ("grpc",), names: Names = NAMES) -> DataFrame:
    """F7. Pipelines whose transport isn't registered. The registry is an argument, so it is part of the filter."""
    return pick_transport(pipelines, names).where(~F.coalesce(F.col("transport").isin(*registry), F.lit(False))).withColumn("error", F.format_string("unknown transport type: %s", "transport"))


def worker_pairs(steps: DataFrame, kinds: tuple[str, ...] = HUB_PRIMITIVES) -> DataFrame:
    """J5, J6. Consecutive workers of each pipeline, and whether a hub primitive lies between them.

    A running count of hub primitives is equal at both ends just if none is between, so one sort per pipeline answers
    what would otherwise be a range join.
    """
    w = Window.partitionBy(*KEY).orderBy("pos")
    hubs = F.sum((F.col("ref").isNull() & is_hub_primitive("type", kinds)).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = steps.withColumn("hubs", hubs).where("ref IS NOT NULL")
    this = F.struct("pos", "key", "name", "ref", "hubs")
    rows = s.select(*KEY, F.lag(this).over(w).alias("up"), this.alias("down")).where("up IS NOT NULL")
    return rows.select(*KEY, "up", "down", (F.col("up.hubs") != F.col("down.hubs")).alias("hub_between"))


def connection_type(pairs: DataFrame, mode: str = "declared") -> DataFrame:
    """J6. ``declared``: through the hub where a hub primitive lies between; ``literal``: always direct."""
    kind = F.when(F.col("hub_between"), HUB).otherwise(DIRECT) if mode == "declared" else F.lit(DIRECT)
    return pairs.withColumn("connection", kind)


def worker_name(run: str, name: str, ref: str, strategy: str = "strategy"):
    """J7. Per-run workers are named by run and step name, shared ones by ref."""
    return F.when(F.col(strategy).eqNullSafe(PER_RUN), F.concat_ws("-", run, name)).otherwise(F.col(ref))


def endpoint_assignments(runs: DataFrame, pipelines: DataFrame, *, mode: str = "declared", names: Names = NAMES, hub_namespace: str | None = None, steps: DataFrame | None = None) -> DataFrame:
    """J8. Per active streaming run and worker: upstream and downstream host (null: none).

    ``declared`` sets both. ``literal`` is the state that survives the original control loop, whose later writes undo
    earlier ones: no upstream, and a direct downstream for all but the last worker.
    A worker that a pipeline uses twice takes the later write.
    """
    steps = explode_steps(pipelines) if steps is None else steps
    live = streaming_runs(runs, pipelines).where("phase = 'active'").select(*KEY, "run", "strategy")
    w = Window.partitionBy(*KEY).orderBy("pos")
    hubs = F.sum((F.col("ref").isNull() & is_hub_primitive("type")).cast("int")).over(w.rowsBetween(Window.unboundedPreceding, 0))
    s = steps.withColumn("hubs", hubs).where("ref IS NOT NULL").select(*KEY, "pos", "name", "ref", "hubs")
    around = {f"{side}_{c}": f(c).over(w) for side, f in (("prev", F.lag), ("next", F.lead)) for c in ("name", "ref", "hubs")}
    rows = s.withColumns(around).join(live, KEY)
    hub = hub_host(F.lit(hub_namespace) if hub_namespace else "namespace", names)

    def host(side: str):
        other = worker_name("run", f"{side}_name", f"{side}_ref")
        through = F.col(f"{side}_hubs") != F.col("hubs") if mode == "declared" else F.lit(False)
        return F.when(F.col(f"{side}_ref").isNotNull(), F.when(through, hub).otherwise(service_host(other, "namespace")))

    up = host("prev") if mode == "declared" else F.lit(None).cast("string")
    out = rows.select("namespace", "run", "pipeline", "pos", worker_name("run", "name", "ref").alias("worker"), up.alias("upstream"), host("next").alias("downstream"))
    return out.groupBy("namespace", "run", "pipeline", "worker").agg(F.max_by(F.struct("upstream", "downstream"), "pos").alias("h")).select("namespace", "run", "pipeline", "worker", "h.*")


def endpoint_drift(assigned: DataFrame, observed: DataFrame) -> DataFrame:
    """J9. Per run, worker and key: action add, update, remove or none, and needs_patch of the worker; absent workers are skipped."""
    both = assigned.join(observed, ["namespace", "worker"])
    keys = [F.struct(F.lit(k).alias("key"), F.col(c).alias("wanted"), F.col("env")[k].alias("found"), F.map_contains_key("env", k).alias("has")) for k, c in ((UPSTREAM, "upstream"), (DOWNSTREAM, "downstream"))]
    action = lambda x: F.when(x["wanted"].isNull(), F.when(x["has"], "remove").otherwise("none")).when(~x["has"], "add").when(x["wanted"].eqNullSafe(x["found"]), "none").otherwise("update")
    patch = reduce(lambda a, b: a | b, [action(k) != "none" for k in keys])
    rows = both.select("namespace", "run", "worker", patch.alias("needs_patch"), F.explode(F.array(*keys)).alias("k"))
    return rows.select("namespace", "run", "worker", "k.key", action(F.col("k")).alias("action"), "needs_patch")


def cleanup_targets(runs: DataFrame, pipelines: DataFrame, observed: DataFrame, *, steps: DataFrame | None = None) -> DataFrame:
    """J10. For runs being deleted whose workers are shared: workers that still carry a host key."""
    steps = explode_steps(pipelines) if steps is None else steps
    gone = streaming_runs(runs, pipelines).where(F.col("phase").eqNullSafe("deleting") & ~F.col("strategy").eqNullSafe(PER_RUN)).select(*KEY).distinct()
    used = steps.where("ref IS NOT NULL").join(gone, KEY, "left_semi").select("namespace", F.col("ref").alias("worker")).distinct()
    carries = F.map_contains_key("env", UPSTREAM) | F.map_contains_key("env", DOWNSTREAM)
    return observed.where(carries).join(used, ["namespace", "worker"], "left_semi").select("namespace", "worker")
