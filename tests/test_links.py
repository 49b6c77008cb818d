"""Links: the batch fold, the SQL fold's queries and the stream against a plain replay."""

import random
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from hubflow import sources, streaming
from hubflow.names import Limits
from hubflow.operators import buffering as buf
from hubflow.operators import metrics as m

LOG = streaming.LOG


def replay(log, cap_n, cap_b, ttl=None, every=None):
    """(seq, outcome) of every packet and (seq, time, fate) of those that left a buffer, one event after the other."""
    sent, left = [], []
    state = {}
    for _, run, step, ts, seq, kind, size in sorted(log, key=lambda r: (r[1], r[2], r[3], r[4])):
        s = state.setdefault((run, step), {"on": False, "held": [], "active": None})
        if ttl is not None and s["active"] is not None:
            tick = 0
            while tick - s["active"] <= ttl:
                tick += every
            if tick <= ts:
                left += [(q, tick, "evicted") for q, _ in s["held"]]
                s.update(held=[], active=None)
        if kind == "connect":
            left += [(q, ts, "delivered") for q, _ in s["held"]]
            s.update(on=True, held=[], active=None)
        elif kind == "disconnect":
            s["on"] = False
        elif s["on"]:
            sent.append((seq, "delivered"))
        else:
            if s["active"] is None:
                s["active"] = ts
            if size > cap_b:
                sent.append((seq, "oversize"))
            elif len(s["held"]) >= cap_n or sum(x for _, x in s["held"]) + size > cap_b:
                sent.append((seq, "buffer_full"))
            else:
                s["held"].append((seq, size))
                s["active"] = ts
                sent.append((seq, "buffered"))
    return sorted(sent), sorted(left)


def make(n=400, seed=3):
    r = random.Random(seed)
    out, t = [], 0
    for seq in range(n):
        t += r.randint(0, 40)
        kind = r.choices(["packet", "connect", "disconnect"], [8, 1, 1])[0]
        out.append(("ns", f"run-{r.randint(0, 3)}", "s", t, seq, kind, r.randint(1, 12) if kind == "packet" else None))
    return out


def frame(spark, log):
    df = spark.createDataFrame([(*r[:3], None, *r[4:]) for r in log], LOG).drop("ts")
    times = spark.createDataFrame([(r[4], r[3]) for r in log], "seq long, t long")
    return df.join(times, "seq").withColumn("ts", F.timestamp_seconds("t")).select(*[c.split()[0] for c in LOG.split(", ")])


def sent_of(df):
    return sorted((r.seq, r.outcome) for r in df.where("event = 'sent'").collect())


def left_of(df):
    return sorted((r.seq, int(r.t), r.outcome) for r in df.where("event = 'left'").withColumn("t", F.unix_seconds("at")).collect())


@pytest.mark.parametrize("ttl", [None, 100])
def test_fates_equal_replay(spark, ttl):
    log = make()
    want_sent, want_left = replay(log, 3, 20, ttl, 60)
    got = buf.link_fates(frame(spark, log), Limits(3, 20, ttl_s=ttl, every_s=60)).cache()
    assert sent_of(got) == want_sent
    assert left_of(got) == want_left
    if ttl is None:
        rows = buf.send_or_buffer(frame(spark, log), 3, 20).collect()
        assert sorted((r.seq, r.outcome) for r in rows) == want_sent
        flushed = {r.seq: r.delivered_at for r in rows if r.outcome == "buffered" and r.delivered_at}
        assert sorted(flushed) == [q for q, _, _ in want_left]


def test_invariants(spark):
    log = frame(spark, make(seed=9))
    fates = buf.send_or_buffer(log, 3, 20).cache()
    assert fates.count() == log.where("kind = 'packet'").count()
    dropped = m.messages_dropped(fates).agg(F.sum("messages")).first()[0]
    assert dropped == fates.where("outcome IN ('oversize', 'buffer_full')").count()
    flushed = m.buffer_flushed(buf.flush_on_connect(fates)).agg(F.sum("messages")).first()[0]
    assert flushed == fates.where("outcome = 'buffered' AND delivered_at IS NOT NULL").count()


def test_greedy_admission(spark):
    log = [("ns", "r", "s", i, i, "packet", size) for i, size in enumerate([4, 9, 3, 20, 2])]
    got = sent_of(buf.link_fates(frame(spark, log), Limits(3, 10)))
    assert [o for _, o in got] == ["buffered", "buffer_full", "buffered", "oversize", "buffered"]


@pytest.mark.parametrize("parts", [1, 5])
def test_large_groups_are_searched(spark, parts):
    """The search gives what the fold gives: hot groups, null keys, repeated rows, null sizes, sizes that shrink, flushes in part."""
    r = random.Random(parts)
    rows = []
    for n in range(3000):
        run = r.choice(["hot", "hot", None, "small sizes", "few"] if n % 40 else ["few"])
        size = r.choice([None, 0, 1, 2, 30, 31, r.randint(1, 40)]) if run != "small sizes" else max(1, 29 - n // 100)
        rows.append(("ns", run, "s", n // 7 if run == "hot" else n, n, "packet", size, r.randint(0, 1) if run is None else 0))
    rows += [("ns", "flushed", "s", n, n, "flush_failed" if n % 50 == 9 else "packet", 2, 0) for n in range(300)]
    rows += [("ns", "few", "s", 10**6, 9999, "packet", 1, 0)] * 3
    df = spark.createDataFrame(rows, "namespace string, run string, step string, t long, seq long, kind string, size long, connect_no long")
    df = df.withColumn("ts", F.timestamp_seconds("t")).repartition(parts)
    for caps in ((5, 30), (300, 30), (0, 30), (40, 10**6)):
        want = buf._fold(df, *caps).collect()
        for waiting in (df, df.drop("kind")) if caps == (5, 30) else (df,):
            got = buf._admit(waiting, *caps, 100)
            key = lambda x: (x.run or "", x.seq, x.outcome, str(x.flushed_at))
            same = [sorted(map(key, (x for x in rows_ if "kind" in waiting.columns or x.run != "flushed"))) for rows_ in (got.collect(), want)]
            assert same[0] == same[1]
    empty = df.where("false")
    assert buf.admit_bounded(empty, 5, 30, 0).collect() == []


def test_eviction_at_and_past_its_time(spark):
    for at, fate in ((600, "delivered"), (661, "evicted")):
        log = [("ns", "r", "s", 0, 0, "packet", 1), ("ns", "r", "s", at, 1, "connect", None)]
        got = left_of(buf.link_fates(frame(spark, log), Limits(ttl_s=600, every_s=60)))
        assert got == [(0, at if fate == "delivered" else 660, fate)]


def test_reconnect_delivers_in_order(spark):
    log = [("ns", "r", "s", t, t, k, 1 if k == "packet" else None) for t, k in enumerate(["connect", "disconnect", "packet", "connect", "packet"])]
    got = buf.link_fates(frame(spark, log)).where("outcome = 'delivered'").orderBy("at", "seq").collect()
    assert [r.seq for r in got] == [2, 4]


def run_stream(spark, log, path, files, limits, **kw):
    df = frame(spark, log).orderBy("ts", "seq").collect()
    per = -(-len(df) // files)
    for k in range(files):
        spark.createDataFrame(df[k * per : (k + 1) * per], LOG).coalesce(1).write.mode("append").parquet(f"{path}/in")
    src = streaming.read_log(spark, f"{path}/in", maxFilesPerTrigger="1")
    q = streaming.stream_link_fates(src, limits, **kw).writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/ck").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(f"{path}/out")


@pytest.mark.parametrize("files", [1, 3])
def test_stream_equals_batch(spark, tmp_path, files):
    log = make(150)
    want = buf.link_fates(frame(spark, log), Limits(3, 20)).cache()
    got = run_stream(spark, log, str(tmp_path), files, Limits(3, 20)).cache()
    assert sent_of(got) == sent_of(want)
    assert left_of(got) == left_of(want)


def test_stream_evicts(spark, tmp_path):
    log = [("ns", "a", "s", 600, 0, "packet", 1), ("ns", "b", "s", 5000, 1, "packet", 1), ("ns", "b", "s", 9000, 2, "packet", 1)]
    got = run_stream(spark, log, str(tmp_path), 3, Limits(ttl_s=600, every_s=60), watermark="1 second")
    assert (0, 1260, "evicted") in left_of(got)


def test_late_packets(spark, tmp_path):
    log = [("ns", "a", "s", 1000, 0, "packet", 1), ("ns", "a", "s", 10, 1, "packet", 1)]
    path = str(tmp_path)
    for r in log:
        frame(spark, [r]).coalesce(1).write.mode("append").parquet(f"{path}/in")
    src = streaming.read_log(spark, f"{path}/in", maxFilesPerTrigger="1")
    q = streaming.stream_link_fates(src, Limits(), lateness_s=60).writeStream.format("memory").queryName("late").outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = spark.sql("SELECT seq, outcome FROM late ORDER BY seq").collect()
    assert sorted(r.outcome for r in rows) in (["buffered", "late"], ["buffered", "buffered"])
    assert sources.dead_letters(spark.table("late")).count() == sum(r.outcome == "late" for r in rows)


def test_windowed_metrics_over_a_stream(spark, tmp_path):
    path = str(tmp_path)
    spark.createDataFrame([("r", "s", i) for i in range(100)], "run string, step_id string, i long").select("run", "step_id", F.timestamp_seconds("i").alias("ts"), F.create_map(F.lit("a"), F.lit("b")).alias("metadata")).write.parquet(f"{path}/in")
    src = spark.readStream.schema("run string, step_id string, ts timestamp, metadata map<string,string>").parquet(f"{path}/in")
    q = m.messages_received(streaming.with_watermark(src), window="10 seconds").writeStream.format("memory").queryName("windowed").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert [r.messages for r in spark.sql("SELECT messages FROM windowed").collect()] == [10] * 10


def test_limits_and_heartbeats(spark):
    assert tuple(m.buffer_limits(spark).first()) == (100, 10 << 20)
    log = frame(spark, [("ns", "r", "s", 0, 0, "connect", None), ("ns", "r", "s", 35, 1, "disconnect", None), ("ns", "r", "s", 100, 2, "connect", None)])
    sessions = buf.link_sessions(log.select("namespace", "run", "step", "ts", "seq", "kind"))
    beats = buf.heartbeat_rows(sessions, until="1970-01-01 00:02:00").withColumn("t", F.unix_seconds("ts")).collect()
    assert sorted(r.t for r in beats) == [10, 20, 30, 110] and {r.payload for r in beats} == {"{}"}
    assert buf.heartbeat_rows(sessions.limit(0)).count() == 0


def test_metrics_of_deliveries(spark):
    rows = spark.createDataFrame([({"storyrun-name": "r", "current-step-id": "s"},), ({"storyrun-name": "r"},), ({"storyrun-name": "", "current-step-id": "s"},), (None,)], "metadata map<string,string>")
    assert [tuple(r) for r in m.messages_sent(rows).collect()] == [("r", "s", 1)]
    calls = spark.createDataFrame([("m", "OK", 0.005), ("m", "OK", 0.2), ("m", "OK", 99.0)], "method string, code string, duration_s double")
    got = {r.le: r.cumulative for r in m.rpc_duration_histogram(calls).collect()}
    assert (got["0.005"], got["0.1"], got["0.25"], got["10"], got["+Inf"]) == (1, 1, 2, 2, 3)
    pods = spark.createDataFrame([(200,), (300,)], "buffer_size int")
    assert tuple(m.scale_signal(pods).first()) == (250.0, 10)


def test_long_link(spark):
    """One link with 200,000 packets: the next connect is found in one step a row."""
    n = 200_000
    log = spark.range(n).select(F.lit("ns").alias("namespace"), F.lit("r").alias("run"), F.lit("s").alias("step"), F.timestamp_seconds("id").alias("ts"), F.col("id").alias("seq"), F.when(F.col("id") % 50_000 == 49_999, "connect").when(F.col("id") % 50_000 == 10, "disconnect").otherwise("packet").alias("kind"), F.lit(1).cast("long").alias("size"))
    rows = buf.with_connection(log)
    wrong = rows.where("NOT (next_connect <=> CASE WHEN seq < 199999 THEN timestamp_seconds((seq div 50000) * 50000 + 49999) END)")
    assert rows.count() == n - 8 and wrong.count() == 0
    assert buf.send_or_buffer(log, 100, None).where("outcome = 'buffered' AND delivered_at IS NOT NULL").count() == 400


def test_failed_sends_and_flushes(spark):
    """A failed send waits, and a flush that ends early keeps what it has not sent, in order, within the limits."""
    events = [("packet", 4), ("packet", 3), ("packet", 2), ("flush_failed", 0), ("packet", 9), ("flush_failed", 2), ("packet", 8), ("connect", None), ("send_failed", 1), ("packet", 1), ("disconnect", None), ("packet", 5), ("connect", None)]
    got = buf.link_fates(frame(spark, [("ns", "r", "s", t, t, k, size) for t, (k, size) in enumerate(events)]), Limits(3, 10))
    assert [o for _, o in sent_of(got)] == ["buffered", "buffered", "buffered", "buffer_full", "buffered", "buffered", "delivered", "buffered"]
    assert left_of(got) == [(0, 5, "delivered"), (1, 5, "delivered"), (2, 7, "delivered"), (6, 7, "delivered"), (8, 12, "delivered"), (11, 12, "delivered")]


# ---- heartbeats


def beats(spark, rows):
    """Rows of (run, seconds, kind)."""
    made = [("d", run, "s", datetime.fromtimestamp(1_700_000_000 + at, timezone.utc), i, kind, None) for i, (run, at, kind) in enumerate(rows)]
    return spark.createDataFrame(made, LOG)


def missed(rows):
    return sorted((r.run, r.due.replace(tzinfo=timezone.utc).timestamp() - 1_700_000_000) for r in rows)


def test_missed_heartbeats(spark):
    rows = [("a", 0, "connect"), ("a", 10, "heartbeat"), ("a", 45, "heartbeat"), ("a", 60, "disconnect"), ("a", 70, "heartbeat"), ("b", 5, "heartbeat"), ("c", 0, "connect"), ("c", 9, "packet"), ("c", 25, "connect")]
    log = beats(spark, rows)
    want = [("a", 20), ("a", 30), ("a", 40), ("a", 55), ("c", 10), ("c", 20)]
    assert missed(buf.missed_heartbeats(log).collect()) == want
    assert missed(buf.missed_heartbeats(log, until="2023-11-14 22:14:00").collect()) == [*want, ("c", 35)]
    assert buf.missed_heartbeats(log.limit(0)).count() == 0
    assert buf.missed_heartbeats(beats(spark, [("a", 0, "connect"), ("a", 365 * 86400, "disconnect")])).count() == 365 * 8640 - 1


@pytest.mark.parametrize("files", [1, 4])
def test_stream_of_missed_heartbeats_equals_batch(spark, tmp_path, files):
    rng, rows = random.Random(files), []
    for run in "abcdef":
        at = 0
        for _ in range(30):
            at += rng.choice([1, 4, 10, 10, 35])
            rows.append((run, at, rng.choice(["connect", "heartbeat", "heartbeat", "disconnect"])))
        rows.append((run, at + 21, "disconnect"))
    rows += [("z", 5000, "connect"), ("z", 5000, "disconnect")]
    rows.sort(key=lambda r: r[1])
    for k in range(files):
        beats(spark, rows).where(f"seq div {-(-len(rows) // files)} = {k}").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    spark.conf.set(*streaming.STATE_STORE)
    told = streaming.stream_missed_heartbeats(streaming.read_log(spark, f"{tmp_path}/in", maxFilesPerTrigger="1"), watermark="1 second")
    told.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    got, want = missed(spark.read.parquet(f"{tmp_path}/out").collect()), missed(buf.missed_heartbeats(beats(spark, rows)).collect())
    assert got == want and len(want) > 20
