"""JSON Schema compiled to a Spark type and to conditions that Catalyst evaluates: all rules of a record kind in one pass over its rows."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_PLAIN = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
Rule = tuple[str, Callable[[Column], Column]]


def _resolved(schema: dict, defs: dict) -> dict:
    while "$ref" in schema:
        schema = defs[schema["$ref"].rpartition("/")[2]]
    return schema


def _types(schema: dict) -> set[str]:
    kinds = schema.get("type", [])
    if not kinds:
        values = schema.get("enum", [schema["const"]] if "const" in schema else [])
        kinds = ["null" if v is None else "boolean" if isinstance(v, bool) else "integer" if isinstance(v, int) else "number" if isinstance(v, float) else "string" for v in values]
    return {kinds} if isinstance(kinds, str) else set(kinds)


def spark_type(schema: dict, defs: dict | None = None) -> T.DataType:
    """The type of a schema's values: objects are structs, integers longs, a type beside null is that type, several others are strings."""
    schema = _resolved(schema, defs or {})
    kinds = _types(schema) - {"null"}
    if kinds == {"array"}:
        return T.ArrayType(spark_type(schema.get("items", {"type": "string"}), defs))
    if kinds == {"object"}:
        return T.StructType([T.StructField(name, spark_type(part, defs)) for name, part in schema.get("properties", {}).items()])
    if kinds == {"integer", "number"}:
        return T.DoubleType()
    return _PLAIN[kinds.pop()] if len(kinds) == 1 else T.StringType()


def _own(schema: dict) -> Iterator[Rule]:
    """The rules of a value itself, which hold for null."""
    values = schema.get("enum", [schema["const"]] if "const" in schema else None)
    if values is not None:
        yield "enum" if "enum" in schema else "const", lambda c: c.isin([v for v in values if v is not None])
    limits = {"minimum": lambda c, v: c >= v, "maximum": lambda c, v: c <= v, "exclusiveMinimum": lambda c, v: c > v, "exclusiveMaximum": lambda c, v: c < v}
    limits |= {"minLength": lambda c, v: F.length(c) >= v, "maxLength": lambda c, v: F.length(c) <= v, "pattern": lambda c, v: c.rlike(v)}
    limits |= {"minItems": lambda c, v: F.size(c) >= v, "maxItems": lambda c, v: F.size(c) <= v}
    for name, holds in limits.items():
        if name in schema:
            yield name, lambda c, holds=holds, value=schema[name]: holds(c, value)
    if schema.get("uniqueItems"):
        yield "uniqueItems", lambda c: F.size(F.array_distinct(c)) == F.size(c)


def rules(schema: dict, defs: dict | None = None, name: str = "", required: bool = True) -> list[Rule]:
    """(name, condition) of all rules of a schema, nested ones too, as functions of the value's column. A name is the place of the value, `[]` for the elements of an
    array, and the keyword. Null is allowed where the type says so or the value isn't required; all elements of an array must meet its items' rules."""
    schema = _resolved(schema, defs or {})
    at = lambda keyword: f"{name}.{keyword}".lstrip(".")
    found: list[Rule] = []
    if required and name and "null" not in _types(schema):
        found.append((at("required"), lambda c: c.isNotNull()))
    for keyword, holds in _own(schema):
        found.append((at(keyword), lambda c, holds=holds: c.isNull() | holds(c)))
    for part, of in schema.get("properties", {}).items():
        for inner, holds in rules(of, defs, at(part), part in schema.get("required", [])):
            found.append((inner, lambda c, part=part, holds=holds: c.isNull() | holds(c.getField(part))))
    if "items" in schema:
        for inner, holds in rules(schema["items"], defs, f"{name}[]"):
            found.append((inner, lambda c, holds=holds: c.isNull() | F.forall(c, lambda x: holds(x))))
    return found


def broken(rows: DataFrame, schema: dict, defs: dict | None = None) -> DataFrame:
    """(rule, broken): how many rows break each rule of an object schema, in one pass. A column that the rows lack counts as null; columns that the schema
    doesn't name are ignored; a condition without an answer is broken. An empty table breaks nothing."""
    schema = _resolved(schema, defs or {})
    held = F.struct(*[(F.col(name) if name in rows.columns else F.lit(None).cast(spark_type(part, defs))).alias(name) for name, part in schema["properties"].items()])
    found = rules(schema, defs)
    record = rows.select(held.alias("_record"))
    counts = record.agg(*[F.count(F.when(~F.coalesce(holds(F.col("_record")), F.lit(False)), 1)).alias(f"r{i}") for i, (_, holds) in enumerate(found)])
    pairs = F.array(*[F.struct(F.lit(name).alias("rule"), F.col(f"r{i}").alias("broken")) for i, (name, _) in enumerate(found)])
    return counts.select(F.explode(pairs).alias("p")).select("p.rule", "p.broken")


def require(rows: DataFrame, schema: dict, defs: dict | None = None) -> None:
    """Raise if a row breaks a rule."""
    if wrong := broken(rows, schema, defs).where("broken > 0").collect():  # as many rows as rules
        raise ValueError("; ".join(f"{r['rule']}: {r['broken']} rows" for r in wrong))


def _object(**properties: dict) -> dict:
    """An object whose properties are required unless marked as optional."""
    return {"type": "object", "properties": properties, "required": [k for k, v in properties.items() if not v.get("optional")]}


_TEXT, _FLAG, _ID, _HASH = {"type": "string"}, {"type": "boolean"}, {"type": "string", "minLength": 1}, {"type": "string", "pattern": "^[0-9a-f]{64}$"}
_NONE = {"type": ["string", "null"]}
_LIST, _SOME = {"type": "array", "items": _ID}, {"type": "array", "items": _ID, "minItems": 1, "uniqueItems": True}
_least = lambda n: {"type": "integer", "minimum": n}
_GRADE = {"type": "integer", "minimum": 0, "maximum": 3}
_ref = lambda name: {"type": "array", "items": {"$ref": f"#/$defs/{name}"}}
#: Record kinds. Their fields and enumerations.
KINDS: dict[str, dict] = {
    "span_ref": _object(source_path=_ID, source_sha256=_HASH, start_line=_least(1), start_column={"type": ["integer", "null"], "minimum": 1}, end_line={"type": ["integer", "null"], "minimum": 1}, end_column={"type": ["integer", "null"], "minimum": 1}, anchor=_NONE, quote_sha256=_HASH, origin_kind={"enum": ["direct", "include", "substitution", "generated"]}),
    "source_span": _object(id=_ID, source_document_id=_ID, span_refs=_ref("span_ref") | {"minItems": 1}),
    "evidence_unit": _object(id=_ID, source_document_id=_ID, node_type=_ID, ordinal=_least(0), heading_path={"type": "array", "items": _TEXT}, section_id=_ID, parent_section_id=_NONE, rendered_text=_TEXT, content_sha256=_HASH),
    "span_fragment": _object(evidence_unit_id=_ID, unit_token_start=_least(0), unit_token_end=_least(1), chunk_token_start=_least(0)),
    "chunk": _object(id=_ID, source_document_id=_ID, text=_TEXT, text_sha256=_HASH, token_count={"type": "integer", "minimum": 0, "maximum": 512}, span_fragments=_ref("span_fragment") | {"minItems": 1}),
    "query": _object(id=_ID, text=_ID, answerability={"enum": ["answerable", "no_answer"]}, no_answer_reason=_NONE),
    "nugget": _object(id=_ID, query_id=_ID, text=_ID, required=_FLAG, source_span_ids=_SOME),
    "judgment": _object(id=_ID, query_id=_ID, source_span_id=_ID, topic_relevance=_FLAG, required_nugget_hits=_LIST, grade=_GRADE),
    "hard_negative": _object(id=_ID, query_id=_ID, source_span_id=_ID, grade={"const": 0}, provenance=_ID),
    "evidence_card": _object(id=_ID, query_id=_ID, rank=_least(1), chunk_id=_ID, token_count=_least(1), cumulative_token_count={"type": "integer", "minimum": 1, "maximum": 2048}, truncated=_FLAG),
    "topic_slot": _object(id=_ID, split={"enum": ["development", "hidden"]}, calibration=_FLAG, answerability={"enum": ["answerable", "no_answer"]}),
    "review_submission": _object(id=_ID, packet_id=_ID, canonical_item_id=_ID, annotator_id=_ID, retrieval_grade={"type": ["integer", "null"], "minimum": 0, "maximum": 3}, selected_source_span_ids=_LIST),
}
