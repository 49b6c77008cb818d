"""One registered query per operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow import functions as X
from hubflow import sources, streaming
from hubflow.names import NAMES, Limits
from hubflow.operators import buffering as buf
from hubflow.operators import metrics as m
from hubflow.operators import packets as pk
from hubflow.operators import resolve, sessions, steps, topology, transform
from hubflow.operators import route as rt
from hubflow.plans import fixtures as fx
from hubflow.plans.fixtures import sql
from hubflow.sources import scratch

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}
#: Caps at which the test links drop packets.
CAPS = {"max_messages": 5, "max_bytes": 60}


def query(text: str | None = None, *views: str) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if text:
            ORACLE[f.__name__] = sql(text, *views)
        return f

    return register


def _routed(s: SparkSession, d: str) -> DataFrame:
    return rt.route(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d), fx.workers(s, d), steps=fx.steps(s, d))


def _log(s: SparkSession, d: str) -> DataFrame:
    return buf.link_log(fx.link_packets(s, d), fx.link_events(s, d))


def _counted(s: SparkSession, d: str) -> DataFrame:
    return buf.send_or_buffer(_log(s, d), 5, None)


def _sized(s: SparkSession, d: str) -> DataFrame:
    return buf.send_or_buffer(_log(s, d), **CAPS)


def _us(c: str) -> F.Column:
    return F.unix_micros(c)


# ---- sources and sinks


@query("SELECT seq, run, step_id FROM packets", "packets")
def s1_read_packets(s, d):
    """Packets written as Parquet in the envelope schema and scanned back."""
    path = scratch(s, "packets")
    fx.packets(s, d).write.parquet(path)
    return sources.read_packets(s, path).select("seq", "run", "step_id")


@query("SELECT seq, run FROM packets WHERE seq % 13 <> 0", "packets")
def s2_unwrap_packets(s, d):
    p = fx.packets(s, d)
    wrapped = p.select(F.when(F.col("seq") % 13 != 0, F.struct(*p.columns)).alias("packet"))
    return sources.unwrap_packets(wrapped).select("seq", "run")


@query("SELECT outcome, count(*) AS packets FROM routed GROUP BY outcome", "routed")
def s3_write_routed(s, d):
    """Routed packets written by outcome and counted from the files."""
    path = scratch(s, "routed")
    _routed(s, d).select("seq", "ts", "run", "target_step", "payload", "outcome").write.partitionBy("outcome").parquet(path)
    return s.read.parquet(path).groupBy("outcome").agg(F.count("*").alias("packets"))


@query(
    """SELECT run || '-' || w_key || '-' || epoch_us(ts) // 1000 AS name, run AS label_run, pipeline AS label_pipeline, step_id AS upstream, inputs IS NOT NULL AS resolved, w_key AS step_id, w_ref AS ref, inputs AS input FROM routed WHERE outcome = 'batch_submitted'""",
    "routed",
)
def s4_build_step_runs(s, d):
    p = NAMES.label_prefix
    r = sources.build_step_runs(_routed(s, d))
    return r.select("name", F.col("labels")[f"{p}storyrun"].alias("label_run"), F.col("labels")[f"{p}story-name"].alias("label_pipeline"), F.col("annotations")[f"{p}upstream-step"].alias("upstream"), F.map_contains_key("annotations", f"{p}inputs-resolved").alias("resolved"), "step_id", "ref", "input")


@query("SELECT seq, outcome FROM routed WHERE outcome IN ('unavailable', 'internal')", "routed")
def s5_dead_letters(s, d):
    return sources.dead_letters(_routed(s, d)).select("seq", "outcome")


# ---- projections and filters


@query(
    """SELECT seq, CASE WHEN seq % 7 = 0 THEN 'missing metadata' WHEN seq % 5 = 0 THEN 'missing storyrun-name metadata' WHEN seq % 3 = 0 THEN 'missing storyrun-namespace metadata' WHEN seq % 2 = 0 THEN 'missing current-step-id metadata' END AS identity_error FROM packets""",
    "packets",
)
def f1_validate_identity(s, d):
    i = F.col("seq")
    first = lambda n, c: F.when(i % n == 0, F.array(F.lit(""))).otherwise(F.array(c, F.lit("other")))
    meta = F.create_map(F.lit("storyrun-name"), first(5, "run"), F.lit("storyrun-namespace"), first(3, "namespace"), F.lit("current-step-id"), F.when(i % 2 == 0, F.array().cast("array<string>")).otherwise(F.array("step_id")))
    return pk.validate_identity(fx.packets(s, d).withColumn("stream_metadata", F.when(i % 7 != 0, meta))).select("seq", "identity_error")


@query("SELECT seq, heartbeat FROM packets", "packets")
def f2_is_heartbeat(s, d):
    return fx.packets(s, d).select("seq", X.is_heartbeat().alias("heartbeat"))


@query("SELECT pipeline, pos, key FROM steps", "steps")
def f3_step_key(s, d):
    return fx.steps(s, d).select("pipeline", "pos", X.step_key().alias("key"))


@query("SELECT pipeline, pos, ref FROM steps WHERE ref IS NOT NULL", "steps")
def f4_worker_steps(s, d):
    return steps.worker_steps(fx.steps(s, d)).select("pipeline", "pos", "ref")


@query("SELECT run, pipeline, strategy, phase FROM live", "live")
def f5_streaming_runs(s, d):
    return topology.streaming_runs(fx.runs(s, d), fx.pipelines(s, d)).select("run", "pipeline", "strategy", "phase")


@query("SELECT pipeline, coalesce(annotation, 'grpc') AS transport FROM pipelines", "pipelines")
def f6_pick_transport(s, d):
    return topology.pick_transport(fx.pipelines(s, d)).select("pipeline", "transport")


@query("SELECT pipeline, annotation AS transport, 'unknown transport type: ' || annotation AS error FROM pipelines WHERE annotation <> 'grpc'", "pipelines")
def f7_unknown_transports(s, d):
    return topology.unknown_transports(fx.pipelines(s, d)).select("pipeline", "transport", "error")


@query("SELECT seq, run, '{\"seen\":true}' AS payload, inputs FROM packets", "packets")
def f8_forward_packet(s, d):
    return pk.forward_packet(fx.packets(s, d), F.lit('{"seen":true}')).select("seq", "run", "payload", "inputs")


@query("SELECT seq, CASE WHEN length(inputs) > 9 THEN 'packet inputs size ' || length(inputs) || ' exceeds limit 9' END AS inputs_error FROM packets", "packets")
def f9_check_inputs_size(s, d):
    return pk.check_inputs_size(fx.packets(s, d), 9).select("seq", "inputs_error")


@query("SELECT seq, coalesce(inputs, CASE WHEN seq % 3 = 0 THEN '{\"a\":1}' END) AS step_input, inputs IS NOT NULL AS inputs_resolved FROM packets", "packets")
def f10_resolve_inputs(s, d):
    return pk.resolve_inputs(fx.packets(s, d).withColumn("target_with", F.when(F.col("seq") % 3 == 0, '{"a":1}'))).select("seq", "step_input", "inputs_resolved")


@query("SELECT p.seq FROM packets p JOIN (SELECT run, min(ts) AS t FROM packets GROUP BY run) s ON p.run = s.run WHERE p.ts < s.t + INTERVAL 10 DAY", "packets")
def f11_session_deadline(s, d):
    p = fx.packets(s, d).withColumn("session_id", F.col("run"))
    return pk.session_deadline(p, p.groupBy("session_id").agg(F.min("ts").alias("started_at")), "10 days").select("seq")


@query("SELECT pipeline, pos, coalesce(type IN ('transform', 'filter'), false) AS hub FROM steps", "steps")
def f12_is_hub_primitive(s, d):
    return fx.steps(s, d).select("pipeline", "pos", X.is_hub_primitive("type").alias("hub"))


@query("SELECT seq, payload FROM routed WHERE outcome = 'deliver' AND n_ref IS NULL AND n_type <> 'transform'", "routed")
def f13_pass_through_primitive(s, d):
    st = steps.with_next(fx.steps(s, d))
    between = resolve.locate_step(resolve.attach_pipeline(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d)), st).where("next_step.ref IS NULL AND next_step.type <> 'transform'").select("seq")
    return _routed(s, d).where("outcome = 'deliver'").join(between, "seq", "left_semi").select("seq", "payload")


@query("SELECT run, seq, n AS dropped_total, outcome AS reason FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS n FROM counted WHERE outcome = 'buffer_full') WHERE n % 10 = 1", "counted")
def f14_sample_drop_warnings(s, d):
    return buf.sample_drop_warnings(_counted(s, d), 10).select("run", "seq", F.col("dropped_total").cast("long"), "reason")


@query("SELECT seq, size FROM log WHERE kind = 'packet' AND size <= 100", "log")
def f15_max_message_filter(s, d):
    return pk.max_message_filter(fx.link_packets(s, d), "size", 100, 200).select("seq", "size")


# ---- joins


@query("SELECT p.seq, r.pipeline FROM packets p LEFT JOIN runs r ON p.run = r.run", "packets", "runs")
def j1_attach_pipeline(s, d):
    return resolve.attach_pipeline(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d)).select("seq", "pipeline")


@query("SELECT seq FROM packets WHERE run NOT IN (SELECT run FROM runs)", "packets", "runs")
def j2_unresolved_packets(s, d):
    return resolve.unresolved_packets(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d)).select("seq")


@query("SELECT seq, pos, n_key FROM located", "located")
def j3_locate_step(s, d):
    p = resolve.attach_pipeline(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d))
    return resolve.locate_step(p, steps.with_next(fx.steps(s, d))).select("seq", "pos", F.col("next_step.key").alias("n_key"))


@query("SELECT seq, coalesce(mode = 'job', false) AS is_job FROM located", "located")
def j4_attach_worker_mode(s, d):
    p = resolve.attach_pipeline(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d))
    return resolve.attach_worker_mode(resolve.locate_step(p, steps.with_next(fx.steps(s, d))), fx.workers(s, d)).select("seq", "is_job")


@query("SELECT pipeline, up_pos, pos AS down_pos FROM paired WHERE up_pos IS NOT NULL", "paired")
def j5_worker_pairs(s, d):
    return topology.worker_pairs(fx.steps(s, d)).select("pipeline", F.col("up.pos").alias("up_pos"), F.col("down.pos").alias("down_pos"))


@query("SELECT pipeline, up_pos, pos AS down_pos, CASE WHEN EXISTS (SELECT 1 FROM steps h WHERE h.pipeline = p.pipeline AND h.pos > p.up_pos AND h.pos < p.pos AND h.ref IS NULL AND h.type IN ('transform', 'filter')) THEN 'HubAndSpoke' ELSE 'PeerToPeer' END AS connection FROM paired p WHERE up_pos IS NOT NULL", "paired")
def j6_connection_type(s, d):
    return topology.connection_type(topology.worker_pairs(fx.steps(s, d))).select("pipeline", F.col("up.pos").alias("up_pos"), F.col("down.pos").alias("down_pos"), "connection")


@query("SELECT l.run, s.pos, CASE WHEN strategy = 'PerStoryRun' THEN l.run || '-' || name ELSE ref END AS worker FROM live l JOIN steps s ON l.pipeline = s.pipeline WHERE ref IS NOT NULL", "live", "steps")
def j7_worker_name(s, d):
    live = topology.streaming_runs(fx.runs(s, d), fx.pipelines(s, d))
    return steps.worker_steps(fx.steps(s, d)).join(live, ["namespace", "pipeline"]).select("run", "pos", topology.worker_name("run", "name", "ref").alias("worker"))


@query("SELECT run, worker, h.u AS upstream, h.d AS downstream FROM assigned", "assigned")
def j8_endpoint_assignments(s, d):
    return topology.endpoint_assignments(fx.runs(s, d), fx.pipelines(s, d), steps=fx.steps(s, d)).select("run", "worker", "upstream", "downstream")


@query(
    """, j AS (SELECT a.run, a.worker, a.h.u AS up, a.h.d AS down, o.* EXCLUDE worker FROM assigned a JOIN observed o ON a.worker = o.worker),
  k AS (SELECT run, worker, 'UPSTREAM_HOST' AS key, up AS wanted, has_up AS has, host FROM j UNION ALL SELECT run, worker, 'DOWNSTREAM_HOST', down, has_down, host FROM j),
  a AS (SELECT *, CASE WHEN wanted IS NULL THEN CASE WHEN has THEN 'remove' ELSE 'none' END WHEN NOT has THEN 'add' WHEN wanted = host THEN 'none' ELSE 'update' END AS action FROM k)
  SELECT run, worker, key, action, bool_or(action <> 'none') OVER (PARTITION BY run, worker) AS needs_patch FROM a""",
    "assigned", "observed",
)
def j9_endpoint_drift(s, d):
    assigned = topology.endpoint_assignments(fx.runs(s, d), fx.pipelines(s, d), steps=fx.steps(s, d))
    return topology.endpoint_drift(assigned, fx.observed_env(s, d)).select("run", "worker", "key", "action", "needs_patch")


@query("SELECT DISTINCT s.ref AS worker FROM live l JOIN steps s ON l.pipeline = s.pipeline JOIN observed o ON o.worker = s.ref WHERE phase = 'deleting' AND strategy <> 'PerStoryRun' AND (has_up OR has_down)", "live", "steps", "observed")
def j10_cleanup_targets(s, d):
    return topology.cleanup_targets(fx.runs(s, d), fx.pipelines(s, d), fx.observed_env(s, d), steps=fx.steps(s, d)).select("worker")


# ---- positions


@query("SELECT pipeline, pos, id, name, ref, type FROM steps", "steps")
def p1_explode_steps(s, d):
    return steps.explode_steps(fx.pipelines(s, d, with_steps=True)).select("pipeline", "pos", "id", "name", "ref", "type")


@query("SELECT pipeline, pos, n_key AS next_key FROM nexts", "nexts")
def p2_next_step(s, d):
    return steps.next_step(fx.steps(s, d)).select("pipeline", "pos", F.col("next_step.key").alias("next_key"))


@query("SELECT pipeline, pos, CAST(w_pos AS INTEGER) AS worker_pos FROM nexts", "nexts")
def p3_next_worker_step(s, d):
    return steps.next_worker_step(fx.steps(s, d)).select("pipeline", "pos", F.col("next_worker.pos").alias("worker_pos"))


@query("SELECT seq, outcome, NOT coalesce(bool_or(outcome IN ('unavailable', 'internal')) OVER (PARTITION BY run, step_id ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS processed FROM routed", "routed")
def p4_fail_stop(s, d):
    return rt.fail_stop(_routed(s, d)).select("seq", "outcome", "processed")


# ---- transforms


@query("SELECT seq, new_payload AS payload FROM routed WHERE n_ref IS NULL AND n_type = 'transform' AND n_definition > 0", "routed")
def t1_apply_transform(s, d):
    st = fx.steps(s, d)
    p = resolve.locate_step(resolve.attach_pipeline(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d)), steps.with_next(st))
    due = p.where("next_step.ref IS NULL AND next_step.type = 'transform'").withColumns({"transform_with": F.col("next_step.with"), "transform_due": F.lit(True)})
    return transform.apply_transform(due, transform.definitions(st)).where("transform_error IS NULL").select("seq", F.col("new_payload").alias("payload"))


@query("""SELECT pipeline, pos, CASE definition WHEN 1 THEN '{"output":"{{ inputs.k || ''-transformed'' }}"}' WHEN 2 THEN '{"double":"{{ inputs.k::double * 2 }}","note":"static"}' END AS with_json FROM steps WHERE type = 'transform'""", "steps")
def t2_rewrite_legacy(s, d):
    return fx.steps(s, d).where("type = 'transform'").select("pipeline", "pos", transform.rewrite_legacy("with").alias("with_json"))


@query("SELECT pipeline, pos, 'transform step is missing ''with'' block' AS error FROM steps WHERE type = 'transform' AND definition = 0", "steps")
def t3_transform_errors(s, d):
    return transform.transform_errors(fx.steps(s, d)).select("pipeline", "pos", "error")


@query("SELECT seq, CAST(payload::JSON->>'k' AS DOUBLE) * 2 AS doubled FROM packets", "packets")
def t4_user_expression(s, d):
    return fx.packets(s, d).withColumn("payload_variant", F.try_parse_json("payload")).select("seq", transform.compile_expression("payload.k::double * 2").alias("doubled"))


NESTED = '{"a":{"b":["{{ payload.k }}","k is {{ payload.k }}, twice {{ payload.k * 2 }}"]},"big":"{{ payload.k > 50 ? \'yes\' : null }}","s":"x"}'


@query("""SELECT seq, '{"a":{"b":[' || k || ',"k is ' || k || ', twice ' || CAST(k * 2 AS DOUBLE) || '"]},"big":' || CASE WHEN k > 50 THEN '"yes"' ELSE 'null' END || ',"s":"x"}' AS payload FROM (SELECT seq, CAST(payload::JSON->>'k' AS BIGINT) AS k FROM packets)""", "packets")
def t1_nested_templates(s, d):
    due = fx.packets(s, d).withColumns({"transform_with": F.lit(NESTED), "transform_due": F.lit(True)})
    return transform.apply_transform(due, [NESTED]).select("seq", F.col("new_payload").alias("payload"))


#: Definitions that fail by packet or as a whole, by packet number modulo 5, and payloads by packet number modulo 4.
FAILING = ('{"x":"{{ 120 % payload.k }}"}', '{"x":"{{ payload.k::int + 1 }}"}', '{"x":"{{ foo( }}"}', '{"x":"{{ payload.k + \'-x\' }}"}', '{"x":"{{ cast(payload.k AS INT) * 2 }}"}')


@query("""SELECT seq, CASE seq % 5 WHEN 0 THEN '{"x":' || CAST(120.0::DOUBLE % nullif(n, 0) AS VARCHAR) || '}' WHEN 1 THEN '{"x":' || (CAST(n AS BIGINT) + 1) || '}' WHEN 3 THEN '{"x":"' || w || '-x"}' WHEN 4 THEN '{"x":' || (CAST(n AS BIGINT) * 2) || '}' END AS payload,
  CASE WHEN seq % 5 = 2 THEN 'cannot compile ''foo('': expected a value' WHEN seq % 5 = 3 AND w IS NULL OR seq % 5 <> 3 AND n IS NULL OR seq % 5 = 0 AND n = 0 THEN 'evaluation error' END AS error
  FROM (SELECT seq, CASE seq % 4 WHEN 0 THEN CAST(payload::JSON->>'k' AS DOUBLE) WHEN 3 THEN 0 END AS n, CASE WHEN seq % 4 = 1 THEN 'word' END AS w FROM packets)""", "packets")
def t3_failing_packets(s, d):
    i = F.col("seq")
    payload = F.when(i % 4 == 0, F.col("payload")).when(i % 4 == 1, '{"k":"word"}').when(i % 4 == 2, "no object").otherwise('{"k":0}')
    which = F.element_at(F.array(*[F.lit(t) for t in FAILING]), (i % 5 + 1).cast("int"))
    due = fx.packets(s, d).withColumns({"payload": payload, "transform_with": which, "transform_due": F.lit(True)})
    return transform.apply_transform(due, list(FAILING)).select("seq", F.col("new_payload").alias("payload"), F.col("transform_error").alias("error"))


@query("""SELECT seq, CASE WHEN outcome IN ('unavailable', 'step_not_found', 'end_of_pipeline', 'heartbeat') OR outcome = 'end_of_worker_chain' AND heartbeat THEN outcome
  WHEN n_ref IS NULL AND n_type = 'transform' AND (n_definition <> 1 OR CAST(payload::JSON->>'k' AS BIGINT) % 2 = 0) THEN 'internal'
  WHEN w_key IS NULL THEN 'end_of_worker_chain' WHEN mode = 'job' THEN 'batch_submitted' ELSE 'deliver' END AS outcome FROM routed""", "routed")
def r1_failing_transforms(s, d):
    """R1 where one definition can't be compiled and another fails for every other packet: only their own packets are internal."""
    line = F.col("with")
    broken = F.when(line == fx.DEFINITIONS[1], '{"n":"{{ 12 % (payload.k % 2) }}"}').when(line == fx.DEFINITIONS[2], FAILING[2])
    return rt.route(fx.packets(s, d), fx.runs(s, d), fx.pipelines(s, d), fx.workers(s, d), steps=fx.steps(s, d).withColumn("with", broken)).select("seq", "outcome")


# ---- routing


@query("SELECT seq, outcome, CASE WHEN outcome IN ('heartbeat', 'batch_submitted', 'deliver') THEN w_key END AS target_step, CASE WHEN outcome IN ('heartbeat', 'batch_submitted', 'deliver') THEN w_ref END AS target_ref, CASE WHEN outcome IN ('deliver', 'batch_submitted') THEN new_payload ELSE payload END AS payload FROM routed", "routed")
def r1_route(s, d):
    return _routed(s, d).select("seq", "outcome", "target_step", "target_ref", "payload")


@query("SELECT seq, w_key AS target_step, payload FROM routed WHERE outcome = 'heartbeat'", "routed")
def r2_heartbeat_route(s, d):
    return rt.heartbeat_route(_routed(s, d)).select("seq", "target_step", "payload")


@query("SELECT seq, run || '/' || step_id AS link FROM packets", "packets")
def r3_link_key(s, d):
    return fx.packets(s, d).select("seq", X.link_key("run", "step_id").alias("link"))


@query("SELECT run, step_id, outcome, count(*) AS packets FROM routed GROUP BY ALL", "routed")
def routed_counts(s, d):
    return _routed(s, d).groupBy("run", "step_id", "outcome").agg(F.count("*").alias("packets"))


def _chain_log(s: SparkSession, d: str, packets: DataFrame | None = None, events: DataFrame | None = None) -> DataFrame:
    """Routed packets with the bytes of what is sent, and the events of their runs' steps."""
    routed = _routed(s, d) if packets is None else rt.route(packets, fx.runs(s, d), fx.pipelines(s, d), fx.workers(s, d), steps=fx.steps(s, d))
    return sessions.run_log(routed, fx.step_events(s, d) if events is None else events, F.octet_length("payload"))


CHAINED = "SELECT run, seq, told AS outcome, CASE WHEN fate IN ('oversize', 'buffer_full') THEN fate END AS reason FROM chained WHERE kind = 'packet'"


@query(CHAINED, "chained")
def r1_resource_exhausted(s, d):
    """R1 with W2 and P4: refused packets end their sender's session and close its link."""
    return sessions.run_fates(_chain_log(s, d), Limits(3, 60)).where("event = 'sent'").select("run", "seq", "outcome", "reason")


@query(CHAINED, "chained")
def r1_stream_sessions(s, d):
    """The same as a stream: packets and events are written, read as streams, routed and followed in one query."""
    path, before = scratch(s, "chain"), s.conf.get(streaming.STATE_STORE[0])
    packets, events = fx.packets(s, d), fx.step_events(s, d)
    packets.write.parquet(f"{path}/packets")
    events.write.parquet(f"{path}/events")
    read = lambda name, like: s.readStream.schema(like.schema).parquet(f"{path}/{name}")
    s.conf.set(*streaming.STATE_STORE)
    try:
        fates = streaming.stream_run_fates(_chain_log(s, d, read("packets", packets), read("events", events)), Limits(3, 60))
        sources.write_routed(fates, f"{path}/out", checkpoint=f"{path}/checkpoint", by=("event",)).awaitTermination()
    finally:
        s.conf.set(streaming.STATE_STORE[0], before)
    return s.read.parquet(f"{path}/out").where("event = 'sent'").select("run", "seq", "outcome", "reason")


@query("""SELECT seq, outcome, NOT coalesce(bool_or(outcome IN ('unavailable', 'internal', 'resource_exhausted')) OVER (PARTITION BY run, step, begun ORDER BY ts, seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS processed
  FROM (SELECT *, count(CASE WHEN kind = 'connect' THEN 1 END) OVER (PARTITION BY run, step ORDER BY ts, seq) AS begun FROM chain_log) WHERE kind = 'packet'""", "chain_log")
def p4_stream_fail_stop(s, d):
    """P4 over a stream: a session that an error ended stays so until its step connects again."""
    path, before = scratch(s, "sessions"), s.conf.get(streaming.STATE_STORE[0])
    _chain_log(s, d).write.parquet(f"{path}/in")
    s.conf.set(*streaming.STATE_STORE)
    try:
        told = streaming.stream_fail_stop(s.readStream.schema(sessions.LOG).parquet(f"{path}/in"))
        sources.write_routed(told, f"{path}/out", checkpoint=f"{path}/checkpoint").awaitTermination()
    finally:
        s.conf.set(streaming.STATE_STORE[0], before)
    return s.read.parquet(f"{path}/out").select("seq", "outcome", "processed")


# ---- links


@query("SELECT run, seq, epoch_us(ts) AS started, epoch_us(ended) AS ended, replaced FROM (SELECT *, lead(ts) OVER w AS ended, coalesce(lead(kind) OVER w = 'connect', false) AS replaced FROM log WHERE kind <> 'packet' WINDOW w AS (PARTITION BY run ORDER BY ts, seq)) WHERE kind = 'connect'", "log")
def w1_link_sessions(s, d):
    return buf.link_sessions(fx.link_events(s, d)).select("run", "seq", _us("started_at").alias("started"), _us("ended_at").alias("ended"), "replaced")


@query("SELECT run, seq, outcome, epoch_us(CASE outcome WHEN 'delivered' THEN ts WHEN 'buffered' THEN next_connect END) AS delivered FROM sized", "sized")
def w2_send_or_buffer(s, d):
    return _sized(s, d).select("run", "seq", "outcome", _us("delivered_at").alias("delivered"))


@query("SELECT run, seq, outcome FROM fold", "fold")
def w3_admit_bounded(s, d):
    return buf.admit_bounded(buf.with_connection(_log(s, d)).where("NOT connected").select(*buf.LINK, "connect_no", "ts", "seq", "size"), **CAPS).select("run", "seq", "outcome")


@query("SELECT run, seq, outcome FROM counted WHERE outcome <> 'delivered'", "counted")
def w3_admit_equal(s, d):
    return buf.admit_equal(buf.with_connection(_log(s, d)).where("NOT connected"), 5).select("run", "seq", "outcome")


@query("SELECT run, connect_no, epoch_us(min(next_connect)) AS flushed_at, count(*) AS flushed FROM sized WHERE outcome = 'buffered' AND next_connect IS NOT NULL GROUP BY run, connect_no", "sized")
def w4_flush_on_connect(s, d):
    return buf.flush_on_connect(_sized(s, d)).select("run", "connect_no", _us("flushed_at").alias("flushed_at"), "flushed")


#: A time to live of two days, looked at every six hours: some buffers of the test links are evicted.
EVICT = Limits(5, 60, ttl_s=2 * 86400, every_s=6 * 3600)


@query("SELECT run, unnest(gone) AS seq, due AS evicted_at FROM evicting", "evicting")
def w5_evict_idle(s, d):
    return buf.evict_idle(buf.link_fates(_log(s, d), EVICT)).select("run", "seq", _us("at").alias("evicted_at"))


@query("SELECT run, CAST(t AS BIGINT) AS tick FROM (SELECT run, unnest(range(epoch_us(ts) + 86400000000, epoch_us(ended), 86400000000)) AS t FROM (SELECT *, lead(ts) OVER (PARTITION BY run ORDER BY ts, seq) AS ended FROM log WHERE kind <> 'packet') WHERE kind = 'connect' AND ended IS NOT NULL)", "log")
def w6_heartbeat_grid(s, d):
    return buf.heartbeat_grid(buf.link_sessions(fx.link_events(s, d)).where("ended_at IS NOT NULL"), "24 hours").select("run", _us("tick").alias("tick"))


def _beats(s: SparkSession, d: str) -> DataFrame:
    """Link events, and a third of the links' packets as heartbeats."""
    beats = fx.link_packets(s, d).where("seq % 3 = 0").select(*buf.LINK, "ts", "seq", F.lit("heartbeat").alias("kind"))
    return fx.link_events(s, d).unionByName(beats)


@query("SELECT run, CAST(t AS BIGINT) AS due FROM (SELECT run, unnest(range(epoch_us(ts) + 86400000000, epoch_us(ended), 86400000000)) AS t FROM (SELECT *, lead(ts) OVER w AS ended, last_value(CASE WHEN kind <> 'packet' THEN kind END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS state FROM log WHERE kind <> 'packet' OR seq % 3 = 0 WINDOW w AS (PARTITION BY run ORDER BY ts, seq)) WHERE state = 'connect' AND ended IS NOT NULL)", "log")
def w6_missed_heartbeats(s, d):
    return buf.missed_heartbeats(_beats(s, d), "24 hours").select("run", _us("due").alias("due"))


@query("SELECT run, seq, outcome FROM sized", "sized")
def w2_stream_links(s, d):
    """The streaming form over the same log, written and read back as a stream that ends when its files do."""
    path, before = scratch(s, "links"), s.conf.get(streaming.STATE_STORE[0])
    # a link's rows lie in one file, so a limit on the bytes of a micro-batch never parts them
    _log(s, d).select(*[c.split()[0] for c in streaming.LOG.split(", ")]).repartition(*buf.LINK).write.parquet(f"{path}/in")
    s.conf.set(*streaming.STATE_STORE)
    try:
        fates = streaming.stream_link_fates(streaming.read_log(s, f"{path}/in"), Limits(**CAPS))
        sources.write_routed(fates, f"{path}/out", checkpoint=f"{path}/checkpoint", by=("event",)).awaitTermination()
    finally:
        s.conf.set(streaming.STATE_STORE[0], before)
    return s.read.parquet(f"{path}/out").where("event = 'sent'").select("run", "seq", "outcome")


@query("SELECT run, step_id AS step, epoch_us(date_trunc('day', ts)) AS day, count(*) AS messages FROM packets WHERE NOT heartbeat GROUP BY ALL", "packets")
def w7_windowed_messages(s, d):
    """A1 with event-time windows and a watermark, which bound its state over a stream."""
    counts = m.messages_received(streaming.with_watermark(fx.packets(s, d)), window="1 day")
    return counts.select("run", "step", _us("window.start").alias("day"), "messages")


#: A packet is late if it is this much older than the latest event of its link.
LATE_S = 5 * 86400


@query(f"SELECT run, seq, coalesce(seq % 4 = 0 AND ts < latest - INTERVAL {LATE_S} SECOND, false) AS late FROM (SELECT *, max(CASE WHEN seq % 4 <> 0 THEN ts END) OVER (PARTITION BY run) AS latest FROM log) WHERE kind = 'packet'", "log")
def w7_late_packets(s, d):
    """A stream that goes on when a quarter of all rows comes later, most of them late: every packet comes out, late ones as such."""
    path, before = scratch(s, "late"), s.conf.get(streaming.STATE_STORE[0])
    rows = _log(s, d).select(*[c.split()[0] for c in streaming.LOG.split(", ")])
    s.conf.set(*streaming.STATE_STORE)
    try:
        for part in ("seq % 4 <> 0", "seq % 4 = 0"):
            # a link's rows of a part lie in one file, so a limit on the bytes of a micro-batch never parts them
            rows.where(part).repartition(*buf.LINK).write.mode("append").parquet(f"{path}/in")
            fates = streaming.stream_link_fates(streaming.read_log(s, f"{path}/in"), Limits(**CAPS), lateness_s=LATE_S)
            sources.write_two_sinks(fates.where("event = 'sent'"), f"{path}/out", f"{path}/dead", checkpoint=f"{path}/checkpoint", outcomes=("late",)).awaitTermination()
    finally:
        s.conf.set(streaming.STATE_STORE[0], before)
    read = lambda name, late: s.read.schema(fates.schema).parquet(f"{path}/{name}").select("run", "seq", F.lit(late).alias("late"))
    return read("out", False).unionByName(read("dead", True))


# ---- metrics


@query("SELECT run, step_id AS step, count(*) AS messages FROM packets WHERE NOT heartbeat GROUP BY ALL", "packets")
def a1_messages_received(s, d):
    return m.messages_received(fx.packets(s, d))


@query("SELECT run, step_id AS step, count(*) AS messages FROM packets WHERE seq IN (SELECT seq FROM sized WHERE outcome = 'delivered' OR outcome = 'buffered' AND next_connect IS NOT NULL) GROUP BY ALL", "packets", "sized")
def a2_messages_sent(s, d):
    sent = _sized(s, d).where("delivered_at IS NOT NULL").select("seq")
    return m.messages_sent(fx.packets(s, d).join(sent, "seq", "left_semi"))


@query("SELECT run, 's1' AS step, outcome AS reason, count(*) AS messages FROM sized WHERE outcome IN ('oversize', 'buffer_full') GROUP BY ALL", "sized")
def a3_messages_dropped(s, d):
    return m.messages_dropped(_sized(s, d))


@query("SELECT run, 's1' AS step, count(*) AS messages FROM sized WHERE outcome = 'buffered' AND next_connect IS NOT NULL GROUP BY ALL", "sized")
def a4_buffer_flushed(s, d):
    return m.buffer_flushed(buf.flush_on_connect(_sized(s, d)))


#: After the last add or flush of a link: nothing if a connect follows its last waiting packet, else what that packet's fold has.
GAUGES = "SELECT run, 's1' AS step, CAST(CASE WHEN next_connect IS NOT NULL THEN 0 ELSE n END AS INTEGER) AS buffer_size, CAST(CASE WHEN next_connect IS NOT NULL THEN 0 ELSE b END AS BIGINT) AS buffer_bytes FROM (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts DESC, seq DESC) AS k FROM fold) WHERE k = 1"


def _fates(s: SparkSession, d: str) -> DataFrame:
    return buf.link_fates(_log(s, d), Limits(**CAPS))


def _troubled(s: SparkSession, d: str) -> DataFrame:
    return buf.send_or_buffer(fx.troubled_log(s, d), **CAPS)


@query("SELECT s.run, s.seq, s.outcome, CASE s.outcome WHEN 'delivered' THEN s.t WHEN 'buffered' THEN g.t END AS delivered FROM troubled s LEFT JOIN (SELECT run, unnest(gone) AS seq, t FROM troubled) g ON g.run = s.run AND g.seq = s.seq WHERE s.outcome IS NOT NULL", "troubled")
def w2_failed_sends(s, d):
    return _troubled(s, d).select("run", "seq", "outcome", _us("delivered_at").alias("delivered"))


@query("SELECT run, t AS flushed_at, len(gone) AS flushed FROM troubled WHERE len(gone) > 0", "troubled")
def w4_flush_in_part(s, d):
    return buf.flush_on_connect(_troubled(s, d)).select("run", _us("flushed_at").alias("flushed_at"), "flushed")


@query("SELECT * FROM troubled_gauges", "troubled_gauges")
def a5_gauges_after_failures(s, d):
    """A5 and A6 where sends fail and flushes end in part."""
    return m.buffer_gauges(buf.link_fates(fx.troubled_log(s, d), Limits(**CAPS)))


@query(f"SELECT run, step, buffer_size FROM ({GAUGES})", "fold")
def a5_buffer_size(s, d):
    return m.buffer_gauges(_fates(s, d)).select("run", "step", "buffer_size")


@query(f"SELECT run, step, buffer_bytes FROM ({GAUGES})", "fold")
def a6_buffer_bytes(s, d):
    return m.buffer_gauges(_fates(s, d)).select("run", "step", "buffer_bytes")


@query(f"SELECT run, step, buffer_size / 5.0::DOUBLE AS messages_used, buffer_bytes / 60.0::DOUBLE AS bytes_used FROM ({GAUGES})", "fold")
def a7_utilisation(s, d):
    return m.utilisation(m.buffer_gauges(_fates(s, d)), Limits(**CAPS))


@query("SELECT method, code, count(*) AS calls FROM calls GROUP BY ALL", "calls")
def a8_rpc_totals(s, d):
    return m.rpc_totals(fx.calls(s, d))


@query(
    ", b AS (SELECT unnest([0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 1e308]) AS bound, unnest(['0.005', '0.01', '0.025', '0.05', '0.1', '0.25', '0.5', '1', '2.5', '5', '10', '+Inf']) AS le) SELECT method, code, le, count(*) FILTER (duration_s <= bound) AS cumulative, count(*) AS count, round(sum(duration_s), 6) AS sum FROM calls, b GROUP BY method, code, le",
    "calls",
)
def a9_rpc_duration_histogram(s, d):
    return m.rpc_duration_histogram(fx.calls(s, d)).withColumn("sum", F.round("sum", 6))


@query("SELECT avg(n) AS mean_buffer, CAST(greatest(2, least(10, ceil(count(*) * avg(n) / 50))) AS INTEGER) AS replicas FROM (SELECT run, count(*) AS n FROM sized WHERE outcome = 'buffered' GROUP BY run)", "sized")
def a10_scale_signal(s, d):
    return m.scale_signal(_sized(s, d).where("outcome = 'buffered'").groupBy("run").agg(F.count("*").alias("buffer_size")))


@query("SELECT run, 's1' AS step, count(*) FILTER (outcome IN ('oversize', 'buffer_full')) AS dropped, count(*) FILTER (outcome = 'buffered') AS buffered FROM sized GROUP BY run", "sized")
def a11_dropped_count(s, d):
    return m.dropped_count(_sized(s, d))


# ---- functions


@query("SELECT seq, CAST(13 + 15 + length(run) + length(step_id) + CASE WHEN heartbeat THEN 17 ELSE 0 END + 1024 AS BIGINT) AS size FROM packets", "packets")
def x1_estimate_size(s, d):
    return fx.packets(s, d).select("seq", X.estimate_size("metadata", F.col("payload").isNotNull()).alias("size"))


@query("SELECT seq, CAST((4 + 13 + length(run) + 2) + (4 + 15 + length(step_id) + 2) + CASE WHEN heartbeat THEN 6 + 17 ELSE 0 END + 2 + (2 + 3 + 2 + 9) + CASE WHEN inputs IS NULL THEN 0 ELSE 2 + (2 + 3 + 2 + 9) END AS BIGINT) AS size FROM packets", "packets")
def x2_wire_size(s, d):
    return fx.packets(s, d).select("seq", X.wire_size("metadata", "payload", "inputs").alias("size"))


@query("SELECT worker, worker || '.default.svc.cluster.local' AS host, 'hub.default.svc.cluster.local' AS hub FROM workers", "workers")
def x3_service_host(s, d):
    return fx.workers(s, d).select("worker", X.service_host("worker", "namespace").alias("host"), X.hub_host("namespace").alias("hub"))


@query("SELECT seq, run || '-' || step_id || '-' || epoch_us(ts) // 1000 AS name FROM packets", "packets")
def x4_step_run_name(s, d):
    return fx.packets(s, d).select("seq", X.step_run_name("run", "step_id", "ts").alias("name"))


@query("SELECT seq, '{\"a\":' || CAST(payload::JSON->>'k' AS BIGINT) || ',\"b\":1}' AS inputs FROM packets", "packets")
def x5_inputs_json(s, d):
    k = F.get_json_object("payload", "$.k")
    return fx.packets(s, d).select("seq", X.inputs_json(F.concat(F.lit('{"b": 1, "a": '), k, F.lit("}"))).alias("inputs"))


@query("SELECT worker, NOT has_up OR host <> 'worker-1.default.svc.cluster.local' AS changed, has_down AS removed, CAST(CASE WHEN has_up THEN 0 ELSE 1 END + has_up::INT + has_down::INT + (NOT has_up AND NOT has_down)::INT AS INTEGER) AS n_after FROM observed", "observed")
def x6_env_upsert(s, d):
    e = fx.observed_env(s, d)
    changed, after = X.env_upsert("env", "UPSTREAM_HOST", F.lit("worker-1.default.svc.cluster.local"))
    return e.select("worker", changed.alias("changed"), X.env_remove("env", "DOWNSTREAM_HOST")[0].alias("removed"), F.size(after).alias("n_after"))
