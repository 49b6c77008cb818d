"""Views of the driver's tables in the data model, as DataFrames and as SQL with the same rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from hubflow.names import NAMES

SPACE = "default"
#: Definitions of transform steps by line number modulo 3.
DEFINITIONS = (None, '{"output":"{{ payload.k || \'-transformed\' }}"}', '{"double":"{{ payload.k::double * 2 }}","note":"static"}')


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def instant(ts: str) -> Column:
    """A time without zone as an instant in UTC, whatever the session's zone."""
    return F.expr(f"timestamp_micros(timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}))")


def steps(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_shipdate")
    flag, number = F.col("l_returnflag"), F.col("l_linenumber").cast("string")
    worker = flag == "N"
    with_ = F.when(F.col("l_linenumber") % 3 == 1, DEFINITIONS[1]).when(F.col("l_linenumber") % 3 == 2, DEFINITIONS[2])
    return li.select(
        F.lit(SPACE).alias("namespace"), F.concat(F.lit("p"), "l_orderkey").alias("pipeline"), (F.row_number().over(order) - 1).alias("pos"),
        F.when(F.col("l_quantity") < 5, "").otherwise(F.concat(F.lit("s"), number)).alias("id"), F.concat(F.lit("n"), number).alias("name"),
        F.when(worker, F.concat(F.lit("worker-"), "l_suppkey")).alias("ref"),
        F.when(worker, None).when(flag == "R", "transform").when(F.col("l_linestatus") == "O", "filter").otherwise("wait").alias("type"),
        F.when(flag == "R", with_).alias("with"),
    ).withColumn("key", F.coalesce(F.nullif("id", F.lit("")), "name"))


def pipelines(spark: SparkSession, sf_dir: str, with_steps: bool = False) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    p = F.col("o_orderpriority")
    kind = F.when(p == "5-LOW", "kafka").when(p == "3-MEDIUM", "").otherwise("grpc")
    rows = o.select(
        F.lit(SPACE).alias("namespace"), F.concat(F.lit("p"), "o_orderkey").alias("pipeline"),
        F.when(F.col("o_orderstatus") == "P", "batch").otherwise("streaming").alias("pattern"),
        F.when(p == "1-URGENT", "PerStoryRun").otherwise("PerStory").alias("strategy"),
        F.when(p == "4-NOT SPECIFIED", F.expr("map('owner', 'x')")).otherwise(F.create_map(F.lit(NAMES.transport), kind)).alias("annotations"),
    )
    if not with_steps:
        return rows
    s = steps(spark, sf_dir)
    body = s.groupBy("namespace", "pipeline").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "id", "name", "ref", "type", "with"))), lambda x: x.dropFields("pos")).alias("steps"))
    return rows.join(body, ["namespace", "pipeline"], "left")


def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("run-"), "o_orderkey").alias("run"), F.concat(F.lit("p"), "o_orderkey").alias("pipeline"), F.when(F.col("o_orderstatus") == "F", instant("o_orderdate")).alias("deleted_at"), F.lit(1).cast("long").alias("generation"))


def workers(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").where(k % 10 != 7).select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("worker-"), k).alias("worker"), F.when(k % 10 == 3, "job").otherwise("deployment").alias("mode"))


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    i = F.col("event_id")
    run = F.when(i % 97 == 0, "ghost").otherwise(F.concat(F.lit("run-"), "user_id"))
    step = F.concat(F.when(i % 11 == 0, "n").otherwise("s"), (i % 8 + 1).cast("string"))
    meta = F.create_map(F.lit("storyrun-name"), run, F.lit("current-step-id"), step)
    beat = F.create_map(F.lit(NAMES.heartbeat), F.lit("true"))
    return e.select(
        i.alias("seq"), instant("ts").alias("ts"), F.lit(SPACE).alias("namespace"), run.alias("run"), step.alias("step_id"),
        F.when(F.col("event_type") == "signup", F.map_concat(meta, beat)).otherwise(meta).alias("metadata"),
        F.col("props").alias("payload"), F.when(i % 2 == 0, F.to_json(F.parse_json(F.to_json(F.struct(F.col("value").alias("v")))))).alias("inputs"),
    )


def link_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')")
    return e.select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("run-"), "user_id").alias("run"), F.lit("s1").alias("step"), instant("ts").alias("ts"), F.col("event_id").alias("seq"), F.when(F.col("event_type") == "signup", "connect").otherwise("disconnect").alias("kind"))


def link_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type NOT IN ('signup', 'error')")
    return e.select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("run-"), "user_id").alias("run"), F.lit("s1").alias("step"), instant("ts").alias("ts"), F.col("event_id").alias("seq"), (F.floor("value") + 1).cast("long").alias("size"))


def troubled_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log with failed sends and partial flushes."""
    i, t = F.col("event_id"), F.col("event_type")
    kind = F.when(t == "signup", F.when(i % 3 == 0, "flush_failed").otherwise("connect")).when(t == "error", "disconnect").otherwise(F.when(i % 5 == 0, "send_failed").otherwise("packet"))
    size = F.when(t == "signup", F.when(i % 3 == 0, i % 4)).when(t != "error", (F.floor("value") / 4).cast("long") + 1)
    return table(spark, sf_dir, "events").select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("run-"), "user_id").alias("run"), F.lit("s1").alias("step"), instant("ts").alias("ts"), i.alias("seq"), kind.alias("kind"), size.cast("long").alias("size"))


def step_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Connects and disconnects of every step of the packets' runs."""
    e, i = table(spark, sf_dir, "events").where("event_type IN ('signup', 'error')"), F.col("event_id")
    return e.select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("run-"), "user_id").alias("run"), F.concat(F.lit("s"), (i % 8 + 1).cast("string")).alias("step"), instant("ts").alias("ts"), (i + 1_000_000_000).alias("seq"), F.when(F.col("event_type") == "signup", "connect").otherwise("disconnect").alias("kind"))


def calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.col("event_type")
    return table(spark, sf_dir, "events").select(F.lit("/proto.v1.HubService/Process").alias("method"), F.when(t == "error", "Internal").when(t == "signup", "Unavailable").otherwise("OK").alias("code"), (F.col("value") / 100).alias("duration_s"))


def observed_env(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What workers carry: by supplier number, some with other values, some without a key, some absent."""
    k = F.col("s_suppkey")
    host = F.concat(F.lit("worker-"), k, F.lit(".default.svc.cluster.local"))
    up, down = F.create_map(F.lit("UPSTREAM_HOST"), host), F.create_map(F.lit("DOWNSTREAM_HOST"), host)
    env = F.when(k % 5 == 0, up).when(k % 3 == 0, F.map_concat(up, down)).when(k % 3 == 1, down).otherwise(F.expr("map('OTHER', 'x')"))
    return table(spark, sf_dir, "supplier").where(k % 7 != 0).select(F.lit(SPACE).alias("namespace"), F.concat(F.lit("worker-"), k).alias("worker"), env.alias("env"))


SQL = {
    "steps": """SELECT *, coalesce(nullif(id, ''), name) AS key FROM (SELECT 'default' AS namespace, 'p' || l_orderkey AS pipeline,
  CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate) - 1 AS INTEGER) AS pos,
  CASE WHEN l_quantity < 5 THEN '' ELSE 's' || l_linenumber END AS id, 'n' || l_linenumber AS name,
  CASE WHEN l_returnflag = 'N' THEN 'worker-' || l_suppkey END AS ref,
  CASE WHEN l_returnflag = 'N' THEN NULL WHEN l_returnflag = 'R' THEN 'transform' WHEN l_linestatus = 'O' THEN 'filter' ELSE 'wait' END AS type,
  CASE WHEN l_returnflag = 'R' THEN l_linenumber % 3 END AS definition FROM lineitem)""",
    "pipelines": """SELECT 'default' AS namespace, 'p' || o_orderkey AS pipeline, CASE WHEN o_orderstatus = 'P' THEN 'batch' ELSE 'streaming' END AS pattern,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'PerStoryRun' ELSE 'PerStory' END AS strategy,
  CASE o_orderpriority WHEN '4-NOT SPECIFIED' THEN NULL WHEN '5-LOW' THEN 'kafka' WHEN '3-MEDIUM' THEN '' ELSE 'grpc' END AS annotation FROM orders""",
    "runs": "SELECT 'default' AS namespace, 'run-' || o_orderkey AS run, 'p' || o_orderkey AS pipeline, CASE WHEN o_orderstatus = 'F' THEN o_orderdate END AS deleted_at FROM orders",
    "workers": "SELECT 'worker-' || s_suppkey AS worker, CASE WHEN s_suppkey % 10 = 3 THEN 'job' ELSE 'deployment' END AS mode FROM supplier WHERE s_suppkey % 10 <> 7",
    "packets": """SELECT event_id AS seq, ts, 'default' AS namespace, CASE WHEN event_id % 97 = 0 THEN 'ghost' ELSE 'run-' || user_id END AS run,
  (CASE WHEN event_id % 11 = 0 THEN 'n' ELSE 's' END) || (event_id % 8 + 1) AS step_id, event_type = 'signup' AS heartbeat, props AS payload,
  CASE WHEN event_id % 2 = 0 THEN '{"v":' || CASE WHEN value = floor(value) THEN CAST(CAST(value AS BIGINT) AS VARCHAR) ELSE CAST(value AS VARCHAR) END || '}' END AS inputs, value FROM events""",
    "log": """SELECT 'run-' || user_id AS run, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN 'connect' WHEN 'error' THEN 'disconnect' ELSE 'packet' END AS kind, CAST(floor(value) AS BIGINT) + 1 AS size FROM events""",
    "calls": "SELECT '/proto.v1.HubService/Process' AS method, CASE event_type WHEN 'error' THEN 'Internal' WHEN 'signup' THEN 'Unavailable' ELSE 'OK' END AS code, value / 100 AS duration_s FROM events",
    "observed": """SELECT 'worker-' || s_suppkey AS worker, s_suppkey % 5 = 0 OR s_suppkey % 3 = 0 AS has_up, s_suppkey % 5 <> 0 AND s_suppkey % 3 IN (0, 1) AS has_down,
  'worker-' || s_suppkey || '.default.svc.cluster.local' AS host FROM supplier WHERE s_suppkey % 7 <> 0""",
    "nexts": """SELECT *, lead(key) OVER w AS n_key, lead(ref) OVER w AS n_ref, lead(type) OVER w AS n_type, lead(definition) OVER w AS n_definition,
  min(CASE WHEN ref IS NOT NULL THEN pos END) OVER (PARTITION BY pipeline ORDER BY pos ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS w_pos
  FROM steps WINDOW w AS (PARTITION BY pipeline ORDER BY pos)""",
    "located": """SELECT p.*, r.pipeline, f.pos, n.n_key, n.n_ref, n.n_type, n.n_definition, x.key AS w_key, x.ref AS w_ref, k.mode FROM packets p LEFT JOIN runs r ON p.run = r.run
  LEFT JOIN (SELECT pipeline, key, min(pos) AS pos FROM steps GROUP BY ALL) f ON f.pipeline = r.pipeline AND f.key = p.step_id
  LEFT JOIN nexts n ON n.pipeline = f.pipeline AND n.pos = f.pos LEFT JOIN steps x ON x.pipeline = f.pipeline AND x.pos = n.w_pos LEFT JOIN workers k ON k.worker = x.ref""",
    "routed": """SELECT *, CASE WHEN pipeline IS NULL THEN 'unavailable' WHEN pos IS NULL THEN 'step_not_found' WHEN n_key IS NULL THEN 'end_of_pipeline'
  WHEN heartbeat THEN CASE WHEN w_key IS NULL THEN 'end_of_worker_chain' ELSE 'heartbeat' END
  WHEN n_ref IS NULL AND n_type = 'transform' AND n_definition = 0 THEN 'internal' WHEN w_key IS NULL THEN 'end_of_worker_chain'
  WHEN mode = 'job' THEN 'batch_submitted' ELSE 'deliver' END AS outcome,
  CASE WHEN n_ref IS NULL AND n_type = 'transform' AND n_definition = 1 THEN '{"output":"' || (payload::JSON->>'k') || '-transformed"}'
  WHEN n_ref IS NULL AND n_type = 'transform' AND n_definition = 2 THEN '{"double":' || CAST(CAST(payload::JSON->>'k' AS DOUBLE) * 2 AS VARCHAR) || ',"note":"static"}' ELSE payload END AS new_payload FROM located""",
    "linked": """SELECT *, coalesce(last_value(CASE WHEN kind <> 'packet' THEN kind = 'connect' END IGNORE NULLS) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), false) AS connected,
  count(CASE WHEN kind = 'connect' THEN 1 END) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS connect_no,
  first_value(CASE WHEN kind = 'connect' THEN ts END IGNORE NULLS) OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next_connect
  FROM log WINDOW w AS (PARTITION BY run ORDER BY ts, seq)""",
    "counted": """SELECT run, connect_no, ts, seq, next_connect, 'delivered' AS outcome FROM linked WHERE kind = 'packet' AND connected
  UNION ALL SELECT run, connect_no, ts, seq, next_connect, CASE WHEN row_number() OVER (PARTITION BY run, connect_no ORDER BY ts, seq) <= 5 THEN 'buffered' ELSE 'buffer_full' END FROM linked WHERE kind = 'packet' AND NOT connected""",
    "waiting": "SELECT *, row_number() OVER (PARTITION BY run, connect_no ORDER BY ts, seq) AS rn FROM linked WHERE kind = 'packet' AND NOT connected",
    "fold": """SELECT run, connect_no, rn, seq, size, ts, next_connect, CASE WHEN size > 60 THEN 'oversize' ELSE 'buffered' END AS outcome, CASE WHEN size > 60 THEN 0 ELSE 1 END AS n, CASE WHEN size > 60 THEN 0 ELSE size END AS b FROM waiting WHERE rn = 1
  UNION ALL SELECT w.run, w.connect_no, w.rn, w.seq, w.size, w.ts, w.next_connect, CASE WHEN w.size > 60 THEN 'oversize' WHEN f.n >= 5 OR f.b + w.size > 60 THEN 'buffer_full' ELSE 'buffered' END,
  f.n + CASE WHEN w.size > 60 OR f.n >= 5 OR f.b + w.size > 60 THEN 0 ELSE 1 END, f.b + CASE WHEN w.size > 60 OR f.n >= 5 OR f.b + w.size > 60 THEN 0 ELSE w.size END
  FROM fold f JOIN waiting w ON w.run = f.run AND w.connect_no = f.connect_no AND w.rn = f.rn + 1""",
    # the whole state of a link after each of its events: two days to live, looked at every six hours; what a tick takes is in gone
    "evicting": """SELECT DISTINCT run, CAST(0 AS BIGINT) AS rn, false AS connected, CAST([] AS BIGINT[]) AS held, CAST(0 AS BIGINT) AS bytes, CAST(NULL AS BIGINT) AS active, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS due FROM log
  UNION ALL SELECT run, rn, CASE kind WHEN 'packet' THEN connected ELSE kind = 'connect' END, CASE WHEN kind = 'connect' THEN [] WHEN fits THEN list_append(had, seq) ELSE had END,
  CASE WHEN kind = 'connect' THEN 0 WHEN fits THEN had_bytes + size ELSE had_bytes END, CASE WHEN kind = 'connect' THEN NULL WHEN fits THEN t WHEN kind = 'packet' AND NOT connected THEN coalesce(had_active, t) ELSE had_active END, gone, due FROM (
  SELECT *, kind = 'packet' AND NOT connected AND size <= 60 AND len(had) < 5 AND had_bytes + size <= 60 AS fits FROM (
  SELECT run, rn, kind, seq, size, t, connected, due, CASE WHEN due <= t THEN held ELSE [] END AS gone, CASE WHEN due <= t THEN [] ELSE held END AS had, CASE WHEN due <= t THEN 0 ELSE bytes END AS had_bytes, CASE WHEN due <= t THEN NULL ELSE active END AS had_active FROM (
  SELECT e.run, e.rn, e.kind, e.seq, e.size, epoch_us(e.ts) AS t, f.connected, f.held, f.bytes, f.active, ((f.active + 172800000000) // 21600000000 + 1) * 21600000000 AS due
  FROM evicting f JOIN (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS rn FROM log) e ON e.run = f.run AND e.rn = f.rn + 1)))""",
    "sized": """SELECT run, connect_no, ts, seq, next_connect, 'delivered' AS outcome FROM linked WHERE kind = 'packet' AND connected UNION ALL SELECT run, connect_no, ts, seq, next_connect, outcome FROM fold""",
    "troubled_log": """SELECT 'run-' || user_id AS run, ts, event_id AS seq, CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN 'flush_failed' ELSE 'connect' END WHEN 'error' THEN 'disconnect' ELSE CASE WHEN event_id % 5 = 0 THEN 'send_failed' ELSE 'packet' END END AS kind,
  CASE event_type WHEN 'signup' THEN CASE WHEN event_id % 3 = 0 THEN event_id % 4 END WHEN 'error' THEN NULL ELSE CAST(floor(value) AS BIGINT) // 4 + 1 END AS size FROM events""",
    # the whole state of a link after each of its events; gone has what the event delivered from the buffer
    "troubled": """SELECT DISTINCT run, CAST(0 AS BIGINT) AS rn, false AS connected, CAST([] AS BIGINT[]) AS held, CAST([] AS BIGINT[]) AS sizes, CAST([] AS BIGINT[]) AS gone, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS BIGINT) AS t, CAST(NULL AS VARCHAR) AS outcome FROM troubled_log
  UNION ALL SELECT run, rn, CASE kind WHEN 'connect' THEN true WHEN 'disconnect' THEN false ELSE connected END, CASE WHEN kind = 'connect' THEN [] WHEN kind = 'flush_failed' THEN held[size + 1:] WHEN outcome = 'buffered' THEN list_append(held, seq) ELSE held END,
  CASE WHEN kind = 'connect' THEN [] WHEN kind = 'flush_failed' THEN sizes[size + 1:] WHEN outcome = 'buffered' THEN list_append(sizes, size) ELSE sizes END, CASE WHEN kind = 'connect' THEN held WHEN kind = 'flush_failed' THEN held[1:size] ELSE [] END, seq, t, outcome FROM (
  SELECT e.run, e.rn, e.kind, e.seq, e.size, epoch_us(e.ts) AS t, f.connected, f.held, f.sizes, CASE WHEN e.kind = 'packet' AND f.connected THEN 'delivered' WHEN e.kind IN ('packet', 'send_failed') THEN CASE WHEN e.size > 60 THEN 'oversize' WHEN len(f.held) >= 5 OR coalesce(list_sum(f.sizes), 0) + e.size > 60 THEN 'buffer_full' ELSE 'buffered' END END AS outcome
  FROM troubled f JOIN (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS rn FROM troubled_log) e ON e.run = f.run AND e.rn = f.rn + 1)""",
    "troubled_gauges": """SELECT run, 's1' AS step, CAST(len(held) AS INTEGER) AS buffer_size, CAST(coalesce(list_sum(sizes), 0) AS BIGINT) AS buffer_bytes FROM (
  SELECT *, row_number() OVER (PARTITION BY run ORDER BY rn DESC) AS k FROM troubled WHERE outcome IN ('buffered', 'buffer_full', 'oversize') OR len(gone) > 0) WHERE k = 1""",
    "chain_log": """SELECT run, step_id AS step, ts, seq, 'packet' AS kind, outcome, w_key AS target, strlen(CASE WHEN outcome IN ('deliver', 'batch_submitted') THEN new_payload ELSE payload END) AS size FROM routed
  UNION ALL SELECT 'run-' || user_id, 's' || (event_id % 8 + 1), ts, event_id + 1000000000, CASE event_type WHEN 'signup' THEN 'connect' ELSE 'disconnect' END, NULL, NULL, NULL FROM events WHERE event_type IN ('signup', 'error')""",
    # the whole state of a run after each of its events: open links, ended sessions, all buffers
    "chained": """SELECT DISTINCT run, CAST(0 AS BIGINT) AS rn, CAST([] AS VARCHAR[]) AS open, CAST([] AS VARCHAR[]) AS ended, CAST([] AS STRUCT(step VARCHAR, seq BIGINT, size BIGINT)[]) AS held, CAST(NULL AS BIGINT) AS seq, CAST(NULL AS VARCHAR) AS kind, CAST(NULL AS VARCHAR) AS told, CAST(NULL AS VARCHAR) AS fate FROM chain_log
  UNION ALL SELECT run, rn, CASE WHEN kind = 'connect' THEN list_append(list_filter(open, lambda x: x <> step), step) WHEN kind = 'disconnect' OR told IN ('unavailable', 'internal', 'resource_exhausted') THEN list_filter(open, lambda x: x <> step) ELSE open END,
  CASE WHEN kind = 'connect' THEN list_filter(ended, lambda x: x <> step) WHEN told IN ('unavailable', 'internal', 'resource_exhausted') THEN list_append(ended, step) ELSE ended END,
  CASE WHEN kind = 'connect' THEN list_filter(held, lambda x: x.step <> step) WHEN told = 'buffered' THEN list_append(held, struct_pack(step := target, seq := seq, size := size)) ELSE held END, seq, kind, told, fate FROM (
  SELECT *, CASE WHEN kind <> 'packet' THEN NULL WHEN skipped THEN 'unprocessed' WHEN fate IN ('oversize', 'buffer_full') THEN CASE outcome WHEN 'heartbeat' THEN 'heartbeat_dropped' ELSE 'resource_exhausted' END ELSE coalesce(fate, outcome) END AS told FROM (
  SELECT *, CASE WHEN kind = 'packet' AND NOT skipped AND outcome IN ('deliver', 'heartbeat') THEN CASE WHEN list_contains(open, target) THEN 'delivered' WHEN size > 60 THEN 'oversize' WHEN len(mine) >= 3 OR coalesce(list_sum(list_transform(mine, lambda x: x.size)), 0) + size > 60 THEN 'buffer_full' ELSE 'buffered' END END AS fate FROM (
  SELECT e.*, f.open, f.ended, f.held, list_contains(f.ended, e.step) AS skipped, list_filter(f.held, lambda x: x.step = e.target) AS mine
  FROM chained f JOIN (SELECT *, row_number() OVER (PARTITION BY run ORDER BY ts, seq) AS rn FROM chain_log) e ON e.run = f.run AND e.rn = f.rn + 1)))""",
    "paired": """SELECT *, lag(pos) OVER w AS up_pos, lag(key) OVER w AS up_key, lag(name) OVER w AS up_name, lag(ref) OVER w AS up_ref, lag(hubs) OVER w AS up_hubs, lead(name) OVER w AS down_name, lead(ref) OVER w AS down_ref, lead(hubs) OVER w AS down_hubs
  FROM (SELECT *, sum(CASE WHEN ref IS NULL AND type IN ('transform', 'filter') THEN 1 ELSE 0 END) OVER (PARTITION BY pipeline ORDER BY pos) AS hubs FROM steps) WHERE ref IS NOT NULL WINDOW w AS (PARTITION BY pipeline ORDER BY pos)""",
    "live": "SELECT r.run, r.pipeline, p.strategy, r.deleted_at, CASE WHEN r.deleted_at IS NULL THEN 'active' ELSE 'deleting' END AS phase FROM runs r JOIN pipelines p ON r.pipeline = p.pipeline WHERE p.pattern = 'streaming'",
    "assigned": """SELECT run, pipeline, worker, max_by(struct_pack(u := upstream, d := downstream), pos) AS h FROM (
  SELECT l.run, s.pipeline, s.pos, CASE WHEN strategy = 'PerStoryRun' THEN l.run || '-' || name ELSE ref END AS worker,
  CASE WHEN up_ref IS NULL THEN NULL WHEN up_hubs <> hubs THEN 'hub.default.svc.cluster.local' ELSE (CASE WHEN strategy = 'PerStoryRun' THEN l.run || '-' || up_name ELSE up_ref END) || '.default.svc.cluster.local' END AS upstream,
  CASE WHEN down_ref IS NULL THEN NULL WHEN down_hubs <> hubs THEN 'hub.default.svc.cluster.local' ELSE (CASE WHEN strategy = 'PerStoryRun' THEN l.run || '-' || down_name ELSE down_ref END) || '.default.svc.cluster.local' END AS downstream
  FROM paired s JOIN live l ON s.pipeline = l.pipeline WHERE l.phase = 'active') GROUP BY run, pipeline, worker""",
}
#: The views that each view needs.
NEEDS = {"nexts": ["steps"], "located": ["packets", "runs", "steps", "nexts", "workers"], "routed": ["located"], "linked": ["log"], "counted": ["linked"], "waiting": ["linked"], "fold": ["waiting"], "evicting": ["log"], "sized": ["linked", "fold"], "troubled": ["troubled_log"], "troubled_gauges": ["troubled"], "chain_log": ["routed"], "chained": ["chain_log"], "paired": ["steps"], "live": ["runs", "pipelines"], "assigned": ["paired", "live"]}


def sql(body: str, *views: str) -> str:
    """The query over the named views and those that they need."""
    done: dict[str, None] = {}

    def add(v: str) -> None:
        for n in NEEDS.get(v, []):
            add(n)
        done.setdefault(v)

    for v in views:
        add(v)
    return f"WITH RECURSIVE {', '.join(f'{v} AS ({SQL[v]})' for v in done)} {body}"
