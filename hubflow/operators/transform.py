"""Per-packet transforms: definitions are compiled once into columns.

A definition is the ``with`` object of a transform step. Strings in it, also in nested objects and lists, may hold
expressions between ``{{`` and ``}}`` (see ``expressions``). One that is all of a string keeps its type; others are joined
with the text around them. Other values stand for themselves. A packet whose values can't be computed fails alone, and a
definition that can't be compiled fails its own packets alone. Expressions are trusted configuration of the pipeline's
owner.
"""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hubflow.operators.expressions import Bad, Compiler, abstract, has_sql, lenient, lower, made_json

#: Most distinct definitions that are columns of their own; more are data, and only their shapes are columns.
GROUP = 64
#: Most bytes of definitions that are broadcast.
SMALL_BYTES = 32 << 20


def rewrite_legacy(with_json: str | Column = "with") -> Column:
    """T2. In top-level strings that are one ``{{ }}`` and mention ``payload.``, reads it as ``inputs.``; the rest stays.

    Works on the few definitions, not on packets. Null and anything but an object stay as they are.
    """
    w = F.col(with_json) if isinstance(with_json, str) else with_json
    fields = F.from_json(F.to_json(F.try_parse_json(w)), "map<string,variant>")

    def one(k: Column, v: Column) -> Column:
        s = F.try_variant_get(v, "$", "string")
        old = F.schema_of_variant(v).eqNullSafe("STRING") & s.rlike(r"(?s)^\{\{.*\}\}$") & s.contains("payload.")
        inner = F.replace(F.trim(F.substring(s, F.lit(3), F.length(s) - 4)), F.lit("payload."), F.lit("inputs."))
        text = F.to_json(F.array(F.concat(F.lit("{{ "), inner, F.lit(" }}"))))
        return F.when(old, F.substring(text, F.lit(2), F.length(text) - 2)).otherwise(F.to_json(v))

    parts = F.transform(F.array_sort(F.map_entries(F.transform_values(fields, one))), lambda e: F.concat(F.substring(F.to_json(F.array(e["key"])), F.lit(2), F.length(F.to_json(F.array(e["key"]))) - 2), F.lit(":"), e["value"]))
    is_object = F.coalesce(F.schema_of_variant(F.try_parse_json(w)).startswith("OBJECT"), F.lit(False))
    return F.when(is_object, F.concat(F.lit("{"), F.array_join(parts, ","), F.lit("}"))).otherwise(w)


def compile_expression(text: str, payload: str = "payload_variant") -> Column:
    """An expression between ``{{`` and ``}}`` as a column over the payload; raises ``ValueError`` if it is none."""
    return lower(Compiler(_session()).expression(text), payload)[1]


def _session() -> SparkSession:
    return SparkSession.getActiveSession() or SparkSession.builder.getOrCreate()


def definitions(steps: DataFrame) -> list[str | None]:
    """The distinct definitions of all transform steps: as many as have been written, whatever the number of packets."""
    rows = steps.where("type = 'transform'").select("with").distinct().collect()
    return sorted((r["with"] for r in rows), key=lambda x: (x is not None, x or ""))


def apply_transform(df: DataFrame, texts: list[str | None], with_col: str = "transform_with", due: str | Column = "transform_due", group: int = GROUP) -> DataFrame:
    """T1, T3, F13. Adds new_payload and transform_error.

    Where ``due``, the definition in ``with_col`` makes the payload, evaluated on the payload alone; a failure gives its
    text. Elsewhere the payload passes through. Packets are read once, without a shuffle or a Python worker, in one
    projection: up to ``group`` definitions are a chained condition. Of more, definitions that are the same but for names
    and literals share a shape; the names and literals come to the packets by a join with the definitions, and a tree of
    conditions picks the shape.
    """
    due = F.col(due) if isinstance(due, str) else due
    compiler, nodes, errors = Compiler(df.sparkSession), {}, {}
    for t in dict.fromkeys(texts):
        try:
            nodes[t] = compiler.definition(t)
        except Bad as e:
            errors[t] = str(e)
    mode = lenient(df.sparkSession) if any(map(has_sql, nodes.values())) else nullcontext()
    with mode:
        out = df.withColumn("payload_variant", F.try_parse_json("payload"))
        made, own = (_by_text if len(nodes) + len(errors) <= group else _by_shape)(nodes, errors, with_col)
        if len(nodes) + len(errors) > group:
            out = _with_slots(out, nodes, errors, with_col)
        out = out.withColumns({"made": F.when(due, made), "own_error": F.when(due, own)})
    failure = F.when(due, F.coalesce("own_error", F.when(F.col("made").isNull(), F.lit("evaluation error"))))
    out = out.withColumns({"transform_error": failure, "new_payload": F.when(due, F.col("made")).otherwise(F.col("payload"))})
    return out.drop("payload_variant", "made", "own_error", "definition")


def _by_text(nodes: dict, errors: dict, with_col: str) -> tuple[Column, Column]:
    made, own = F.lit(None).cast("string"), F.lit(None).cast("string")
    for t, node in nodes.items():
        made = F.when(F.col(with_col) == t, made_json(node)).otherwise(made)
    for t, error in errors.items():
        own = F.when(F.col(with_col).eqNullSafe(F.lit(t)), F.lit(error)).otherwise(own)
    return made, own


def _shapes(nodes: dict) -> tuple[dict, list[tuple]]:
    """For each definition its shape's number and its names and literals; the shapes."""
    of, shapes = {}, {}
    for t, node in nodes.items():
        values: list[str] = []
        of[t] = (shapes.setdefault(abstract(node, values), len(shapes)), values)
    return of, list(shapes)


def _by_shape(nodes: dict, errors: dict, with_col: str) -> tuple[Column, Column]:
    shapes = [made_json(s, F.col("definition.slots")) for s in _shapes(nodes)[1]] or [F.lit(None).cast("string")]

    def pick(low: int, high: int) -> Column:
        middle = (low + high) // 2
        return shapes[low] if high - low == 1 else F.when(F.col("definition.shape") < middle, pick(low, middle)).otherwise(pick(middle, high))

    own = F.coalesce("definition.error", F.when(F.col(with_col).isNull(), F.lit(errors.get(None))))
    return F.when(F.col("definition.shape").isNotNull(), pick(0, len(shapes))), own


def _with_slots(df: DataFrame, nodes: dict, errors: dict, with_col: str) -> DataFrame:
    rows = [(t, shape, slots, None) for t, (shape, slots) in _shapes(nodes)[0].items()] + [(t, None, None, e) for t, e in errors.items() if t is not None]
    of = df.sparkSession.createDataFrame(rows, "text string, shape int, slots array<string>, error string").select(F.col("text").alias("definition_text"), F.struct("shape", "slots", "error").alias("definition"))
    small = sum(len(t) + sum(map(len, slots or ())) + len(e or "") for t, _, slots, e in rows) <= SMALL_BYTES
    return df.join(F.broadcast(of) if small else of, df[with_col] == of["definition_text"], "left").drop("definition_text")


def transform_errors(steps: DataFrame) -> DataFrame:
    """T3. Transform steps whose definition is missing, no JSON object, or can't be compiled, with the error's text."""
    compiler, wrong = Compiler(steps.sparkSession), []
    for t in definitions(steps):
        try:
            compiler.definition(t)
        except Bad as e:
            wrong.append((t, str(e)))
    of = steps.sparkSession.createDataFrame(wrong, "wrong_text string, error string")
    # a shuffle would bring all steps of one definition, such as a missing one, to one task
    small = sum(len(t or "") + len(e) for t, e in wrong) <= SMALL_BYTES
    return steps.where("type = 'transform'").join(F.broadcast(of) if small else of, F.col("with").eqNullSafe(F.col("wrong_text"))).drop("wrong_text")
