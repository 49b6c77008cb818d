"""Many small keys and few large ones: buckets of a stream's keys change no row, and frequent values stay where they are."""

import pytest
from pyspark.sql import functions as F

from hubflow import streaming
from hubflow.names import Limits
from hubflow.operators import route as rt
from hubflow.operators import transform
from tests.test_sessions import processed, random_runs, replay, run_frame


class Timers:
    """The part of a handle that a processor uses, in memory; it counts the calls."""

    def __init__(self):
        self.maps, self.timers, self.calls = {}, [], 0

    def getMapState(self, name, *_):
        self.maps[name] = Kept(self)
        return self.maps[name]

    def registerTimer(self, timer):
        self.timers.append(timer)

    def getCurrentWatermarkInMs(self):
        return 0


class Kept(dict):
    def __init__(self, handle):
        self.handle = handle

    def exists(self):
        self.handle.calls += 1
        return bool(self)

    def getValue(self, key):
        self.handle.calls += 1
        return self.get(key)

    def updateValue(self, key, value):
        self.handle.calls += 1
        self[key] = value

    def removeKey(self, key):
        self.handle.calls += 1
        self.pop(key, None)


def stream(spark, path, src, name, make, **options):
    log = spark.readStream.schema(src.schema).options(**options).parquet(f"{path}/in")
    make(log).writeStream.format("parquet").option("path", f"{path}/{name}").option("checkpointLocation", f"{path}/{name}-ck").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{path}/{name}").collect()


def in_parts(df, path, parts):
    times = [r.ts for r in df.select("ts").distinct().orderBy("ts").collect()]
    edges = [times[len(times) * k // parts] for k in range(parts)]
    for k, low in enumerate(edges):
        rows = df.where(F.col("ts") >= low) if k + 1 == parts else df.where((F.col("ts") >= low) & (F.col("ts") < edges[k + 1]))
        rows.coalesce(1).write.mode("append").parquet(f"{path}/in")


@pytest.mark.parametrize("buckets", [1, 3])
def test_buckets_of_sessions_change_nothing(spark, tmp_path, buckets):
    rows = random_runs(300, 7)
    log = run_frame(spark, rows)
    in_parts(log, tmp_path, 3)
    got = stream(spark, tmp_path, log, "stops", lambda s: streaming.stream_fail_stop(s, (*rt.ERRORS,), buckets=buckets), maxFilesPerTrigger="1")
    assert sorted(((r.seq, str(r.processed).lower(), None) for r in got), key=str) == processed(rows)
    ts = {r.seq: r.ts for r in log.collect()}
    assert all(r.ts == ts[r.seq] for r in got)


def test_a_session_takes_no_call_without_an_error():
    """10,000 sessions of which one fails: a call to ask, one to keep it."""
    import pandas as pd

    handle, stops = Timers(), streaming.SessionProcessor(("internal",), None)
    stops.init(handle)
    rows = pd.DataFrame([("ns", "r", f"s{i}", i, pd.Timestamp(0), "packet", "internal" if i == 7 else "deliver", i) for i in range(10_000)], columns=["namespace", "run", "step", "seq", "ts", "kind", "outcome", "at_us"])
    (out,) = stops.handleInputRows((0,), iter([rows]), handle)
    assert len(out) == 10_000 and out["processed"].all() and handle.calls == 2
    assert list(handle.maps["kept"]) == [("ns", "r", "s7")]


def test_steps_of_one_wrong_definition_stay_apart(spark):
    """Steps without a definition are as many as there are pipelines, so they aren't shuffled by it."""
    steps = spark.range(1000).select(F.col("id").alias("pos"), F.lit("transform").alias("type"), F.when(F.col("id") % 2 == 0, F.lit("[1]")).when(F.col("id") % 5 == 0, F.lit("{}")).alias("with"))
    errors = transform.transform_errors(steps)
    assert errors.count() == 900 and errors.where("with IS NULL").count() == 400 and errors.where("error IS NULL").count() == 0
    plan = errors._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("buckets", [1, 3])
def test_buckets_of_runs_change_nothing(spark, tmp_path, buckets):
    rows = random_runs(300, 8)
    log = run_frame(spark, rows)
    in_parts(log, tmp_path, 3)
    got = stream(spark, tmp_path, log, "runs", lambda s: streaming.stream_run_fates(s, Limits(3, 20), buckets=buckets).where("event = 'sent'"), maxFilesPerTrigger="1")
    assert sorted(((r.seq, r.outcome, r.reason) for r in got), key=str) == replay(rows, 3, 20)


def test_timers_of_a_bucket_are_shared():
    """1,000 idle links in one bucket: one timer, which evicts all of them, and what is kept says so."""
    import pandas as pd

    handle, links = Timers(), streaming.LinkProcessor(Limits(ttl_s=600, every_s=60))
    links.init(handle)
    rows = pd.DataFrame([("ns", "r", f"s{i}", i, "packet", 1, i) for i in range(1000)], columns=["namespace", "run", "step", "seq", "kind", "size", "at_us"])
    (out,) = links.handleInputRows((0,), iter([rows]), handle)
    assert set(out["outcome"]) == {"buffered"} and len(out) == 1000 and len(handle.timers) == 1
    handle.getExpiryTimeInMs = lambda: handle.timers[0]
    (gone,) = links.handleExpiredTimer((0,), handle, handle)
    assert set(gone["outcome"]) == {"evicted"} and sorted(gone["seq"]) == list(range(1000))
    assert not handle.maps["due"] and all(v[5] == [] for v in handle.maps["kept"].values())
