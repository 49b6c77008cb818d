"""Cases of the model's own tests: envelopes, identity, forwarding, transforms, topology."""

import json
import random

import pytest
from pyspark.sql import functions as F

from hubflow import functions as X
from hubflow import schema, sources
from hubflow.names import NAMES
from hubflow.operators import packets as pk
from hubflow.operators import route as rt
from hubflow.operators import steps as st
from hubflow.operators import topology, transform

DEFINITION = json.dumps({"output": "{{ payload.key + '-transformed' }}"})


def step(id_, ref=None, kind=None, with_=None, name=None):
    return (id_, name or f"name-{id_}", ref, kind, with_)


def tables(spark, steps, *, mode="deployment", strategy="PerStory", annotations=None, deleted=None):
    p = spark.createDataFrame([("ns", "p", "streaming", strategy, annotations, steps)], schema.PIPELINES)
    r = spark.createDataFrame([("ns", "run", "p", deleted, 1)], schema.RUNS)
    w = spark.createDataFrame([("ns", s[2], mode) for s in steps if s[2]] or [("ns", "none", mode)], schema.WORKERS)
    return r, p, w


def packet(spark, step_id, payload='{"key":"value"}', inputs=None, metadata=None, run="run"):
    return spark.createDataFrame([(1, None, "ns", run, step_id, metadata or {"storyrun-name": run, "current-step-id": step_id}, payload, inputs)], schema.PACKETS)


def one(spark, steps, p, **kw):
    return rt.route(p, *tables(spark, steps, **kw)).first()


def test_forward_unchanged(spark):
    r = one(spark, [step("step1", "worker1"), step("step2", "worker2")], packet(spark, "step1"))
    assert (r.outcome, r.target_step, r.payload) == ("deliver", "step2", '{"key":"value"}')


def test_transform(spark):
    steps = [step("step1", "e1"), step("step2", None, "transform", DEFINITION), step("step3", "e3")]
    r = one(spark, steps, packet(spark, "step1"))
    assert (r.outcome, r.target_step, json.loads(r.payload)) == ("deliver", "step3", {"output": "value-transformed"})


@pytest.mark.parametrize("with_, text", [(None, "transform step is missing 'with' block"), ("[1]", "transform step's 'with' is not a JSON object"), ("{", "transform step's 'with' is not a JSON object"), ('{"a":"{{ payload.missing }}"}', "evaluation error")])
def test_transform_failures(spark, with_, text):
    r = one(spark, [step("a", "e1"), step("b", None, "transform", with_)], packet(spark, "a"))
    assert (r.outcome, r.error) == ("internal", text)


def test_other_primitives_and_later_ones_pass_through(spark):
    steps = [step("a", "e1"), step("b", None, "filter"), step("c", None, "transform", DEFINITION), step("d", "e2")]
    r = one(spark, steps, packet(spark, "a"))
    assert (r.outcome, r.target_step, r.payload) == ("deliver", "d", '{"key":"value"}')


def test_ends_and_misses(spark):
    steps = [step("a", "e1"), step("b", None, "filter")]
    assert one(spark, steps, packet(spark, "a")).outcome == "end_of_worker_chain"
    assert one(spark, steps, packet(spark, "b")).outcome == "end_of_pipeline"
    assert one(spark, steps, packet(spark, "x")).outcome == "step_not_found"
    assert one(spark, steps, packet(spark, "a", run="ghost")).outcome == "unavailable"


def test_heartbeat_skips_transform_and_jobs(spark):
    steps = [step("a", "e1"), step("b", None, "transform", None), step("c", "e2")]
    r = one(spark, steps, packet(spark, "a", metadata={NAMES.heartbeat: "true"}), mode="job")
    assert (r.outcome, r.target_step) == ("heartbeat", "c")


def test_duplicate_keys_take_the_first_step(spark):
    steps = [step("a", "e1"), step("b", "e2"), step("a", "e3"), step("c", "e4")]
    assert one(spark, steps, packet(spark, "a")).target_step == "b"


def test_batch_inputs(spark):
    steps = [step("a", "e1"), step("b", "e2", with_='{"s":1}')]
    p = tables(spark, steps, mode="job")
    r = sources.build_step_runs(rt.route(packet(spark, "a", inputs='{"b":2,"a":1}').withColumn("ts", F.timestamp_millis(F.lit(1500))), *p)).first()
    assert (r.name, r.input, r.annotations[f"{NAMES.label_prefix}inputs-resolved"]) == ("run-b-1500", '{"a":1,"b":2}', "true")
    assert rt.route(packet(spark, "a"), *p).first().step_input == '{"s":1}'
    at = rt.route(packet(spark, "a", inputs='{"a":"xx"}'), *p, max_inputs=10).first()
    over = rt.route(packet(spark, "a", inputs='{"a":"xxx"}'), *p, max_inputs=10).first()
    assert (at.outcome, over.outcome, over.error) == ("batch_submitted", "internal", "packet inputs size 11 exceeds limit 10")


def test_missing_identity(spark):
    df = spark.createDataFrame([(None,), ({"storyrun-name": []},), ({"storyrun-name": ["r"], "storyrun-namespace": ["n"], "current-step-id": ["s", "t"]},)], "stream_metadata map<string,array<string>>")
    assert [r.identity_error for r in pk.validate_identity(df).collect()] == ["missing metadata", "missing storyrun-name metadata", None]


def test_sizes(spark):
    df = spark.createDataFrame([({}, "{}"), ({"key1": "value1", "key2": "value2"}, "{}")], "m map<string,string>, p string")
    assert [r[0] for r in df.select(X.estimate_size("m", F.col("p").isNotNull())).collect()] == [1024, 1044]
    assert spark.range(1).select(X.estimate_size(F.lit(None).cast("map<string,string>"), F.lit(True), F.lit(None).cast("string"))).first()[0] == 0
    # a = 1 (true), a string of 200 bytes, null, and a nested list
    sizes = spark.createDataFrame([("{}",), ('{"a":true}',), ('{"a":"' + "x" * 200 + '"}',), ('{"a":null,"b":[1,"x"]}',), (None,), ("[1]",)], "p string")
    got = [r[0] for r in sizes.select(X.wire_size(F.create_map().cast("map<string,string>"), "p", F.lit(None).cast("string"))).collect()]
    assert got == [2, 11, 2 + 1 + 3 + (2 + 1) + (3 + 203), 2 + (2 + 3 + 4) + (2 + 3 + 2 + (2 + 11 + 5)), 0, 0]


def framed(n):
    return 1 + max(1, -(-n.bit_length() // 7)) + n


def encoded(x):
    """Bytes of a dynamic value, by recursion."""
    if isinstance(x, dict):
        return framed(sum(framed(framed(len(k.encode())) + framed(encoded(v))) for k, v in x.items()))
    if isinstance(x, list):
        return framed(sum(framed(encoded(v)) for v in x))
    return framed(len(x.encode())) if isinstance(x, str) else 2 if x is None or isinstance(x, bool) else 9


def test_struct_size_of_any_depth(spark):
    rng = random.Random(5)
    words = ["", "a", '"', "\\", "\\\"{[,:]}", "é\n\u0001", "日本😀", ":", "true", "x" * 130, "\\u0041", "7"]

    def value(depth):
        kind = rng.randrange(8 if depth else 5)
        if kind < 5:
            return (rng.choice(words), rng.choice([0, -1.5, 10**15, 1e-9]), True, False, None)[kind]
        return [value(depth - 1) for _ in range(rng.randrange(4))] if kind == 5 else {rng.choice(words) + str(i): value(depth - 1) for i in range(rng.randrange(5))}

    objects = [{str(i) + rng.choice(words): value(5) for i in range(rng.randrange(6))} for _ in range(200)]
    deep = {"a": 1}
    for i in range(200):
        deep = {"k": deep, "n": None} if i % 2 else {"l": [[], deep, "s"]}
    objects += [deep, {"big": "y" * 300_000}, {"many": list(range(20_000))}, {"": {}}]
    texts = [json.dumps(x, ensure_ascii=i % 2 == 0, indent=i % 3 or None) for i, x in enumerate(objects)]
    odd = ['{"a":1,"a":"xyz"}', '{"a":"\\ud800"}', '{"a":' + "[" * 100_000 + "]" * 100_000 + "}", " [1] ", '"{"', "{", "", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts + odd)], "i int, t string")
    sizes = df.select("i", X.json_struct_size("t"))
    got = [r[1] for r in sorted(sizes.collect())]
    assert got == [encoded(x) for x in objects] + [encoded({"a": "xyz"}), encoded({"a": "xyz"})] + [0] * 6


def test_rewrite_legacy(spark):
    df = spark.createDataFrame([('{"a":"{{payload.x}}","b":"payload.x","c":{"d":"{{ payload.x }}"},"e":1}',), (None,), ("[1]",)], "with string")
    got = [r[0] for r in df.select(transform.rewrite_legacy("with")).collect()]
    assert json.loads(got[0]) == {"a": "{{ inputs.x }}", "b": "payload.x", "c": {"d": "{{ payload.x }}"}, "e": 1} and got[1:] == [None, "[1]"]


def test_forbidden_expressions(spark):
    for text in ("(select 1)", "rand()", "current_timestamp()", "raise_error('x')", "foo(", "nope.a", "payload.a.b[payload.i]", "payload.a rlike '('", "1 +", "payload.a::nothing", "@"):
        with pytest.raises(ValueError):
            transform.compile_expression(text)


GOOD = '{"key":"value","a":5,"b":2,"t":true,"list":[1,2],"a b":"q","n":null}'
ODD = '{"key":7,"a":"abc","b":0,"list":{"q":1},"t":1}'
#: Expression, and what it makes of ``GOOD`` and of ``ODD``; ... where it fails.
EXPRESSIONS = [
    ("payload.key + '-transformed'", "value-transformed", ...), ("payload.key || '-x'", "value-x", "7-x"), ("payload.a", 5, "abc"), ("payload", json.loads(GOOD), json.loads(ODD)),
    ("payload.list", [1, 2], {"q": 1}), ("payload.n", None, ...), ("payload.a::int / payload.b::int", 2.5, ...), ("payload.a + 1", 6, ...), ("payload.a + payload.a", 10, "abcabc"), ("payload.a % payload.b", 1, ...), ("-payload.a", -5, ...),
    ("payload.a > 3 && has(payload.key) ? 'big' : 0", "big", ...), ("payload.a == 5 || payload.zz > 1", True, ...), ("payload.t || payload.zz == 1", True, ...), ("!payload.t", False, ...), ("not (payload.b > 1)", False, True),
    ("payload.key in ['value', 'y']", True, False), ("2 in payload.list", True, ...), ("payload.a != 'abc'", True, False), ("payload.n == null", True, ...), ("payload.key < 'w'", True, ...), ("payload.a == payload.b", False, False), ("payload.key == 7", False, True),
    ("size(payload.list) + size(payload.key)", 7, ...), ("payload.key.startsWith('va') and payload.key.contains('lu')", True, False), ("upper(payload['key'])", "VALUE", "7"), ("payload['a b']", "q", ...), ("payload.list[1]", 2, ...),
    ("coalesce(payload.zz, payload.key, 1)", "value", 7), ("floor(payload.a / 2)", 2, ...), ("abs(0 - payload.b)", 2, 0), ("substring(payload.key, 2, 2)", "al", ""), ("replace(payload.key, 'a', 'o')", "volue", "7"), ("string(payload.a) + '!'", "5!", "abc!"), ("[payload.a, 'x']", [5, "x"], ["abc", "x"]),
    ("9223372036854775807 + 1", ..., ...), ("'it\\'s'", "it's", "it's"), ("reverse(payload.key)", "eulav", "7"), ("cast(payload.key AS INT)", ..., 7), ("element_at(split(payload.key, 'u'), 5)", ..., ...), ("make_date(2020, payload.a::int, 1)", "2020-05-01", ...), ("payload.key rlike '^v'", True, False),
]


@pytest.mark.parametrize("group", [64, 1])
def test_expressions(spark, group):
    """Each failure stays with its packet; definitions as columns and as data give the same."""
    rows = [(i, json.dumps({"x": f"{{{{ {e} }}}}"}), p) for i, (e, _, _) in enumerate(EXPRESSIONS) for p in (GOOD, ODD)]
    df = spark.createDataFrame(rows, "i long, transform_with string, payload string").withColumn("transform_due", F.lit(True))
    got = {(r.i, r.payload): r for r in transform.apply_transform(df, [r[1] for r in rows], group=group).collect()}
    for i, (e, *want) in enumerate(EXPRESSIONS):
        for p, w in zip((GOOD, ODD), want, strict=True):
            r = got[(i, p)]
            if w is ...:
                assert (r.new_payload, r.transform_error) == (None, "evaluation error"), (e, p)
            else:
                assert (json.loads(r.new_payload), r.transform_error) == ({"x": w}, None), (e, p)
    assert spark.conf.get("spark.sql.ansi.enabled") == "true"


def test_templates_in_texts_and_objects(spark):
    with_ = json.dumps({"o": {"l": [1, "{{ payload.a }}", {"z": "p-{{ upper(payload.key) }}"}]}, "both": "{{ payload.a }} and {{ payload.b }}", "odd": "{{ '}}' + payload.key }}", "none": None, "open": "{{ x"})
    bad = json.dumps({"ok": 1, "deep": {"bad": "{{ foo( }}"}})
    rows = [(1, with_, GOOD), (2, with_, '{"a":1}'), (3, bad, GOOD), (4, "{}", None), (5, '{"s":"plain"}', "broken")]
    df = spark.createDataFrame(rows, "i long, transform_with string, payload string").withColumn("transform_due", F.lit(True))
    got = {r.i: (r.new_payload and json.loads(r.new_payload), r.transform_error) for r in transform.apply_transform(df, [r[1] for r in rows]).collect()}
    assert got[1] == ({"o": {"l": [1, 5, {"z": "p-VALUE"}]}, "both": "5 and 2", "odd": "}}value", "none": None, "open": "{{ x"}, None)
    assert got[2] == (None, "evaluation error") and got[3][1].startswith("cannot compile 'foo('")
    assert got[4] == ({}, None) and got[5] == ({"s": "plain"}, None)


def test_one_read_for_all_definitions(spark, tmp_path):
    """2,000 definitions with a few shapes: one scan of the packets, few conditions."""
    texts = [json.dumps({f"n{i}": f"{{{{ payload.k{i % 7} || '-{i}' }}}}", "fixed": i}) for i in range(2000)]
    rows = [(i, t, json.dumps({f"k{i % 7}": "a"})) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "i long, transform_with string, payload string").write.parquet(f"{tmp_path}/p")
    out = transform.apply_transform(spark.read.parquet(f"{tmp_path}/p").withColumn("transform_due", F.lit(True)), texts)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange hash" not in plan
    assert all(json.loads(r.new_payload) == {f"n{r.i}": f"a-{r.i}", "fixed": r.i} for r in out.collect())


def test_errors_of_definitions(spark):
    steps = [step("a", "e1"), *[step(f"t{i}", None, "transform", w) for i, w in enumerate((None, "[1]", '{"a":"{{ foo( }}"}', '{"a":"{{ payload.a }}"}'))]]
    _, p, _ = tables(spark, steps)
    got = {r.id: r.error for r in transform.transform_errors(st.explode_steps(p)).collect()}
    assert got == {"t0": "transform step is missing 'with' block", "t1": "transform step's 'with' is not a JSON object", "t2": "cannot compile 'foo(': expected a value"}


A_B_C = [step("a", "ea"), step("b", "eb"), step("t", None, "transform", "{}"), step("c", "ec")]


@pytest.mark.parametrize("mode", ["declared", "literal"])
def test_topology(spark, mode):
    r, p, _ = tables(spark, A_B_C)
    got = {x.worker: (x.upstream, x.downstream) for x in topology.endpoint_assignments(r, p, mode=mode).collect()}
    hub, of = "hub.ns.svc.cluster.local", lambda w: f"{w}.ns.svc.cluster.local"
    if mode == "declared":
        assert got == {"ea": (None, of("eb")), "eb": (of("ea"), hub), "ec": (hub, None)}
    else:
        assert got == {"ea": (None, of("eb")), "eb": (None, of("ec")), "ec": (None, None)}


def test_topology_edges(spark):
    r, p, _ = tables(spark, [step("a", "ea")])
    assert [(x.upstream, x.downstream) for x in topology.endpoint_assignments(r, p).collect()] == [(None, None)]
    r, p, _ = tables(spark, [])
    assert topology.endpoint_assignments(r, p).count() == 0
    r, p, _ = tables(spark, [step("a", "e1"), step("b", "e2"), step("c", "e1")])
    assert {x.worker: x.upstream for x in topology.endpoint_assignments(r, p).collect()}["e1"] == "e2.ns.svc.cluster.local"
    r, p, _ = tables(spark, A_B_C, strategy="PerStoryRun")
    assert {x.worker for x in topology.endpoint_assignments(r, p).collect()} == {"run-name-a", "run-name-b", "run-name-c"}


def test_empty_transport_annotation(spark):
    _, p, _ = tables(spark, A_B_C, annotations={NAMES.transport: ""})
    assert topology.pick_transport(p).first().transport == "" and topology.unknown_transports(p).count() == 1
    _, p, _ = tables(spark, A_B_C)
    assert topology.pick_transport(p).first().transport == "grpc"


def test_drift(spark):
    assigned = spark.createDataFrame([("ns", "run", "p", "w", "u", None)], "namespace string, run string, pipeline string, worker string, upstream string, downstream string")
    for env, want in (({}, ["add", "none"]), ({"UPSTREAM_HOST": "u"}, ["none", "none"]), ({"UPSTREAM_HOST": "x", "DOWNSTREAM_HOST": "y"}, ["update", "remove"])):
        seen = spark.createDataFrame([("ns", "w", env)], schema.OBSERVED_ENV)
        rows = sorted(topology.endpoint_drift(assigned, seen).collect(), key=lambda r: r.key, reverse=True)
        assert [r.action for r in rows] == want and rows[0].needs_patch == (want != ["none", "none"])


def test_next_worker_of_empty_pipeline(spark):
    _, p, _ = tables(spark, [])
    assert st.with_next(st.explode_steps(p)).count() == 0


def test_stream_of_routed_packets(spark, tmp_path):
    """S1 to S3 as a stream give what the batch gives, with the input in several files."""
    steps = [step("a", "e1"), step("t", None, "transform", DEFINITION), step("b", "e2")]
    dims = tables(spark, steps)
    rows = spark.createDataFrame([(i, None, "ns", "run", "a" if i % 3 else "x", {}, json.dumps({"key": str(i)}), None) for i in range(30)], schema.PACKETS)
    rows.repartition(4).write.parquet(f"{tmp_path}/in")
    live = rt.route(sources.read_packets(spark, f"{tmp_path}/in", streaming=True, maxFilesPerTrigger="1"), *dims)
    sources.write_routed(live, f"{tmp_path}/out", checkpoint=f"{tmp_path}/ck").awaitTermination()
    pick = lambda df: sorted((r.seq, r.outcome, r.payload) for r in df.collect())
    assert pick(spark.read.parquet(f"{tmp_path}/out")) == pick(rt.route(rows, *dims))


def test_many_definitions(spark):
    """More definitions than one projection takes: each packet is transformed once, by its own; others pass through."""
    texts = [None, "no object", *[f'{{"n":"{{{{ payload.k || \'-{i}\' }}}}"}}' for i in range(2000)]]
    rows = [(i, t, '{"k":"a"}', i % 5 != 4) for i, t in enumerate(texts)] + [(9000, "unknown", '{"k":"a"}', True), (9001, None, "{}", False)]
    df = spark.createDataFrame(rows, "i long, transform_with string, payload string, transform_due boolean")
    got = {r.i: r for r in transform.apply_transform(df, texts, group=100).collect()}
    assert len(got) == len(rows) and got[0].transform_error.endswith("missing 'with' block") and got[1].transform_error.endswith("not a JSON object")
    for i, t, payload, due in rows[2:-2]:
        assert (got[i].new_payload, got[i].transform_error) == (f'{{"n":"a-{i - 2}"}}' if due else payload, None)
    assert got[9000].transform_error == "evaluation error" and got[9001].new_payload == "{}"
