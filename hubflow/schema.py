"""Schemas of the tables. Payloads and inputs are JSON at rest and VARIANT where they are read."""

PACKETS = "seq BIGINT, ts TIMESTAMP, namespace STRING, run STRING, step_id STRING, metadata MAP<STRING,STRING>, payload STRING, inputs STRING"
ENVELOPES = f"packet STRUCT<{', '.join(': '.join(c.split(' ', 1)) for c in PACKETS.split(', '))}>"
STEP = "STRUCT<id: STRING, name: STRING, ref: STRING, type: STRING, with: STRING>"
PIPELINES = f"namespace STRING, pipeline STRING, pattern STRING, strategy STRING, annotations MAP<STRING,STRING>, steps ARRAY<{STEP}>"
RUNS = "namespace STRING, run STRING, pipeline STRING, deleted_at TIMESTAMP, generation BIGINT"
WORKERS = "namespace STRING, worker STRING, mode STRING"
LINK_EVENTS = "namespace STRING, run STRING, step STRING, ts TIMESTAMP, seq BIGINT, kind STRING"
OBSERVED_ENV = "namespace STRING, worker STRING, env MAP<STRING,STRING>"
CALLS = "method STRING, code STRING, duration_s DOUBLE"
