"""Sessions chained into links, running values over ranges of time, failed sends in the table form, long sessions."""

import random

import pytest
from pyspark.sql import functions as F

from hubflow import sources, streaming
from hubflow.names import Limits
from hubflow.operators import buffering as buf
from hubflow.operators import packets as pk
from hubflow.operators import ranges, sessions
from hubflow.operators import route as rt

LOG = "namespace string, run string, step string, ts timestamp, seq long, kind string, size long"


def instants(df):
    return df.withColumn("ts", F.timestamp_seconds("at")).drop("at")


def random_log(n, seed, kinds, links=3):
    r = random.Random(seed)
    rows = [("ns", "r", f"s{r.randrange(links)}", r.randrange(n // 2), i, r.choice(kinds), r.randrange(12)) for i in range(n)]
    rows += [(None, None, None, r.randrange(n), n + i, r.choice(kinds), 3) for i in range(20)]
    return rows


def frame(spark, rows):
    return instants(spark.createDataFrame(rows, "namespace string, run string, step string, at long, seq long, kind string, size long"))


KINDS = ["connect", "disconnect", "packet", "packet", "packet", "packet", "send_failed", "flush_failed"]


def test_ranges_of_time_change_nothing(spark, monkeypatch):
    """Rows of a link in many ranges get what one window gives."""
    log = frame(spark, random_log(600, 3, KINDS, 2)).cache()
    see = lambda df: sorted(map(str, df.select(*sorted(df.columns)).collect()))
    sets = [lambda: buf.with_connection(log), lambda: buf.link_sessions(log.where("kind IN ('connect', 'disconnect')")), lambda: buf.send_or_buffer(log, 3, 20), lambda: buf.sample_drop_warnings(buf.link_fates(log, Limits(3, 20)).where("event = 'sent'"), 5)]
    one = [see(f()) for f in sets]
    monkeypatch.setattr(ranges, "LEAST", 20)
    assert ranges.time_ranges(log) is not None
    assert [see(f()) for f in sets] == one
    monkeypatch.setattr(ranges, "RANGES", 3)
    assert [see(f()) for f in sets] == one
    # ranges are even: the rows of one link, dealt by them, spread over tasks
    spread = log.where("step = 's0'").groupBy(ranges.time_ranges(log).alias("k")).count().collect()
    assert len(spread) == 3 and max(r["count"] for r in spread) < 200


@pytest.mark.parametrize("batch", ["2", "10000"])
def test_failed_sends_as_a_table(spark, batch):
    """The table form gives what the pass over each link gives, with batches that part groups anywhere."""
    log = frame(spark, random_log(500, 7, KINDS)).cache()
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        got = {r.seq: (r.outcome, r.delivered_at) for r in buf.send_or_buffer(log, 3, 20).collect()}
        fates = buf.link_fates(log, Limits(3, 20)).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    left = {r.seq: r["at"] for r in fates if r.event == "left"}
    assert got == {r.seq: (r.outcome, r["at"] if r.outcome == "delivered" else left.get(r.seq)) for r in fates if r.event == "sent"}
    assert {"delivered", "buffered", "buffer_full"} <= {o for o, _ in got.values()}


def test_partial_flush_needs_sizes(spark):
    log = frame(spark, [("ns", "r", "s", 1, 1, "packet", 1), ("ns", "r", "s", 2, 2, "flush_failed", 1)])
    with pytest.raises(Exception, match="partial flushes need max_bytes"):
        buf.send_or_buffer(log, 3, None).collect()


def test_gauge_after_a_flush_in_part(spark):
    from hubflow.operators import metrics

    events = [("packet", 4), ("packet", 5), ("packet", 6), ("flush_failed", 1)]
    log = frame(spark, [("ns", "r", "s", t, t, k, n) for t, (k, n) in enumerate(events)])
    assert [tuple(r) for r in metrics.buffer_gauges(buf.link_fates(log)).collect()] == [("r", "s", 2, 11)]
    failed = frame(spark, [("ns", "r", "s", t, t, k, n) for t, (k, n) in enumerate([("connect", None), ("send_failed", 4), ("packet", 5)])])
    assert [(r.seq, r.outcome) for r in buf.send_or_buffer(failed).orderBy("seq").collect()] == [(1, "buffered"), (2, "delivered")]


def test_a_year_of_heartbeats(spark):
    """Ticks come in stretches; the grid is that of a sequence."""
    s = spark.createDataFrame([("ns", "r", "s", 0, 365 * 86400), ("ns", "r", "t", 5, 35), ("ns", "r", "u", 5, 36), ("ns", "r", "v", 5, 14), ("ns", "r", "w", 5, None)], "namespace string, run string, step string, a long, b long")
    s = s.select("namespace", "run", "step", F.timestamp_seconds("a").alias("started_at"), F.timestamp_seconds("b").alias("ended_at"))
    got = {r.step: (r.n, r.first, r.last) for r in buf.heartbeat_grid(s).groupBy("step").agg(F.count("*").alias("n"), F.min(F.unix_seconds("tick")).alias("first"), F.max(F.unix_seconds("tick")).alias("last")).collect()}
    assert got == {"s": (365 * 8640 - 1, 10, 365 * 86400 - 10), "t": (2, 15, 25), "u": (3, 15, 35)}
    assert buf.heartbeat_grid(s, "1 day", "1970-01-03 00:00:05").where("step = 'w'").count() == 1


# sessions


def replay(rows, most, size_cap):
    """The rules of sessions and buffers, one event after another."""
    open_, ended, held, told = {}, set(), {}, []
    for ns, run, step, _, seq, kind, outcome, target, size in sorted(rows, key=lambda r: (r[3], r[4])):
        me, to = (ns, run, step), (ns, run, target)
        if kind == "connect":
            open_[me], held[me] = True, []
            ended.discard(me)
        elif kind == "disconnect":
            open_[me] = False
        elif me in ended:
            told.append((seq, "unprocessed", None))
        elif outcome in ("deliver", "heartbeat"):
            mine, why = held.setdefault(to, []), None
            if open_.get(to):
                fate = "delivered"
            elif size > size_cap:
                why = "oversize"
            elif len(mine) >= most or sum(mine) + size > size_cap:
                why = "buffer_full"
            else:
                mine.append(size)
                fate = "buffered"
            if why:
                fate = "heartbeat_dropped" if outcome == "heartbeat" else "resource_exhausted"
            told.append((seq, fate, why))
            if fate == "resource_exhausted":
                ended.add(me)
                open_[me] = False
        else:
            told.append((seq, outcome, None))
            if outcome in ("unavailable", "internal"):
                ended.add(me)
                open_[me] = False
    return sorted(told, key=str)


def random_runs(n, seed):
    r, rows = random.Random(seed), []
    for i in range(n):
        run, step = f"r{r.randrange(4)}", r.randrange(4)
        kind = r.choice(["connect", "disconnect", *["packet"] * 6])
        outcome = r.choice([*["deliver"] * 8, "heartbeat", "internal", "unavailable", "end_of_pipeline", "batch_submitted"]) if kind == "packet" else None
        target = f"s{step + 1}" if outcome in ("deliver", "heartbeat", "batch_submitted") else None
        rows.append(("ns", run, f"s{step}", r.randrange(n // 3), i, kind, outcome, target, r.randrange(25) if kind == "packet" else None))
    return rows


def run_frame(spark, rows):
    return instants(spark.createDataFrame(rows, "namespace string, run string, step string, at long, seq long, kind string, outcome string, target string, size long")).select(*[c.split()[0] for c in sessions.LOG.split(", ")])


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_sessions_against_a_replay(spark, seed):
    rows = random_runs(800, seed)
    fates = sessions.run_fates(run_frame(spark, rows), Limits(3, 20)).collect()
    got = sorted(((r.seq, r.outcome, r.reason) for r in fates if r.event == "sent"), key=str)
    assert got == replay(rows, 3, 20)
    assert {"resource_exhausted", "unprocessed", "buffered", "delivered"} <= {o for _, o, _ in got}
    # what waits leaves at most once
    left = [r.seq for r in fates if r.event == "left"]
    assert len(left) == len(set(left)) and set(left) <= {s for s, o, _ in got if o == "buffered"}
    assert sessions.run_fates(run_frame(spark, rows).where("false")).count() == 0


def test_sessions_over_a_stream(spark, tmp_path):
    """State survives from micro-batch to micro-batch: one file each, in order of time."""
    rows = random_runs(300, 5)
    rows.sort(key=lambda r: (r[3], r[4]))
    edges = sorted({r[3] for r in rows})[:: max(1, len({r[3] for r in rows}) // 4)]
    for i, low in enumerate(edges):
        high = edges[i + 1] if i + 1 < len(edges) else 10**9
        run_frame(spark, [r for r in rows if low <= r[3] < high]).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    for name, make, want in (
        ("runs", lambda s: streaming.stream_run_fates(s, Limits(3, 20)).where("event = 'sent'").select("seq", "outcome", "reason"), replay(rows, 3, 20)),
        ("stops", lambda s: streaming.stream_fail_stop(s, (*rt.ERRORS,)).select("seq", F.col("processed").cast("string").alias("outcome"), F.lit(None).cast("string").alias("reason")), processed(rows)),
    ):
        src = spark.readStream.schema(sessions.LOG).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = make(src).writeStream.format("parquet").option("path", f"{tmp_path}/{name}").option("checkpointLocation", f"{tmp_path}/{name}-ck").outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination()
        assert len(q.recentProgress) >= 4
        assert sorted((tuple(r) for r in spark.read.parquet(f"{tmp_path}/{name}").collect()), key=str) == want


def processed(rows):
    ended, out = set(), []
    for _, run, step, _, seq, kind, outcome, *_ in sorted(rows, key=lambda r: (r[3], r[4])):
        if kind == "connect":
            ended.discard((run, step))
        elif kind == "packet":
            out.append((seq, str((run, step) not in ended).lower(), None))
            if outcome in rt.ERRORS:
                ended.add((run, step))
    return sorted(out, key=str)


def test_first_errors_by_aggregate(spark):
    """P4 needs no window: what follows the first error of a session, in order of time and number, isn't processed."""
    rows = [("ns", "r", "a", 1, 1, "deliver"), ("ns", "r", "a", 2, 2, "internal"), ("ns", "r", "a", 2, 3, "deliver"), ("ns", "r", "b", 9, 4, "deliver"), (None, None, None, 1, 5, "unavailable"), (None, None, None, 1, 6, None)]
    df = instants(spark.createDataFrame(rows, "namespace string, run string, step_id string, at long, seq long, outcome string"))
    out = rt.fail_stop(df)
    assert {r.seq: r.processed for r in out.collect()} == {1: True, 2: True, 3: False, 4: True, 5: True, 6: False}
    assert "Window" not in out._jdf.queryExecution().executedPlan().toString()


# late packets, two sinks, deadlines over streams


@pytest.mark.parametrize("limits", [Limits(), Limits(ttl_s=600, every_s=60)])
def test_every_packet_comes_out(spark, tmp_path, limits):
    """Rows in are rows out, whether late by the link's own time or behind the watermark."""
    files = [[("ns", "a", "s", 100_000 + i, i, "packet", 1) for i in range(5)], [("ns", "b", "s", 100_100, 10, "packet", 1)], [("ns", "a", "s", 10 + i, 20 + i, "packet", 1) for i in range(3)] + [("ns", "c", "s", 20, 30, "packet", 1), ("ns", "c", "s", 100_200, 31, "packet", 1)]]
    for rows in files:
        frame(spark, rows).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = streaming.read_log(spark, f"{tmp_path}/in", maxFilesPerTrigger="1")
    fates = streaming.stream_link_fates(src, limits, lateness_s=None if limits.ttl_s else 60, watermark="1 minute").where("event = 'sent'")
    sources.write_two_sinks(fates, f"{tmp_path}/out", f"{tmp_path}/dead", checkpoint=f"{tmp_path}/ck").awaitTermination()
    out, dead = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("out", "dead"))
    assert sorted(r.seq for r in out.unionByName(dead).collect()) == [0, 1, 2, 3, 4, 10, 20, 21, 22, 30, 31]
    assert {r.outcome for r in dead.collect()} == {"late"}
    # a link of its own has no time of its own yet, so it is late by the watermark alone
    assert sorted(r.seq for r in dead.collect()) == ([20, 21, 22, 30] if limits.ttl_s else [20, 21, 22])


def test_a_batch_that_failed_between_its_sinks(spark, tmp_path):
    """The restarted query runs the batch again and nothing is there twice."""
    df = spark.createDataFrame([(i, "late" if i % 3 == 0 else "delivered") for i in range(30)], "seq long, outcome string")
    for k in range(3):
        df.where(f"seq % 3 = {k} OR seq div 10 = {k}").where(f"seq div 10 = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    src = lambda: spark.readStream.schema("seq long, outcome string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    # dead letters are written first; the second sink fails on a row of the second batch
    fails = F.when((F.col("seq") == 11) & (F.col("outcome") != "late"), F.raise_error(F.lit("killed"))).otherwise(F.col("seq")).cast("long")
    with pytest.raises(Exception, match="killed"):
        sources.write_two_sinks(src().withColumn("seq", fails), f"{tmp_path}/out", f"{tmp_path}/dead", checkpoint=f"{tmp_path}/ck").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/out").count() < 20
    sources.write_two_sinks(src(), f"{tmp_path}/out", f"{tmp_path}/dead", checkpoint=f"{tmp_path}/ck").awaitTermination()
    out, dead = (spark.read.parquet(f"{tmp_path}/{x}") for x in ("out", "dead"))
    assert sorted(r.seq for r in dead.collect()) == list(range(0, 30, 3))
    assert sorted(r.seq for r in out.collect()) == [i for i in range(30) if i % 3]


def test_deadline_over_two_streams(spark, tmp_path):
    packets = instants(spark.createDataFrame([(i, f"s{i % 3}", 1000 + 100 * (i % 3) + i) for i in range(90)], "seq long, session_id string, at long"))
    begun = spark.createDataFrame([(f"s{k}", 1000 + 100 * k) for k in range(3)], "session_id string, at long").select("session_id", F.timestamp_seconds("at").alias("started_at"))
    packets.write.parquet(f"{tmp_path}/p")
    begun.write.parquet(f"{tmp_path}/s")
    live = pk.session_deadline(spark.readStream.schema(packets.schema).parquet(f"{tmp_path}/p"), spark.readStream.schema(begun.schema).parquet(f"{tmp_path}/s"))
    q = live.select("seq").writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start()
    q.awaitTermination()
    want = sorted(r.seq for r in pk.session_deadline(packets, begun).collect())
    assert sorted(r.seq for r in spark.read.parquet(f"{tmp_path}/out").collect()) == want == list(range(30))
    assert "EventTimeWatermark" in live._jdf.queryExecution().logical().toString()
