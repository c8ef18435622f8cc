"""JSON Schema to Spark types and back, and edits of schemas. Driver-side: schemas are small."""

from __future__ import annotations

import copy
import json
from typing import Any

from pyspark.sql import types as T

from fieldloom.errors import DiscoveryError, SchemaError
from fieldloom.functions.plain import strip_fences

_SCALARS = {"string": T.StringType(), "integer": T.LongType(), "number": T.DoubleType(), "boolean": T.BooleanType()}
_NAMES = {v: k for k, v in _SCALARS.items()}
DEEPEST = 10
Json = dict[str, Any]
WRAPPED = "x-with-sources"


def object_of(*required: str, **fields: str | Json) -> Json:
    """A schema of an object: fields by type name or by schema."""
    out: Json = dict(type="object", properties={k: dict(type=v) if isinstance(v, str) else v for k, v in fields.items()})
    return out | {"required": list(required)} if required else out


def resolve_refs(schema: Json) -> Json:
    """The schema with local references put in place; cycles, unknown ones and deep ones become free objects."""
    known = {**schema.get("definitions", {}), **schema.get("$defs", {})}

    def visit(node: Any, open_: tuple[str, ...]) -> Any:
        if isinstance(node, list):
            return [visit(x, open_) for x in node]
        if not isinstance(node, dict):
            return node
        if "$ref" in node:
            name = str(node["$ref"]).rsplit("/", 1)[-1]
            if name not in known or name in open_ or len(open_) >= DEEPEST:
                return {"type": "object"}
            extra = {k: v for k, v in node.items() if k != "$ref"}
            return visit(known[name], (*open_, name)) | visit(extra, open_)
        return {k: visit(v, open_) for k, v in node.items() if k not in ("$defs", "definitions")}

    return visit(schema, ())


def _resolved(prop: Json) -> Json:
    """The first branch of a union that isn't null; a string if all are."""
    for key in ("anyOf", "oneOf"):
        if prop.get(key):
            some = [b for b in prop[key] if b.get("type") != "null"]
            return _resolved(some[0]) if some else {"type": "string"}
    if isinstance(prop.get("type"), list):
        some = [t for t in prop["type"] if t != "null"]
        return {**prop, "type": some[0] if some else "string"}
    return prop


def spark_type(prop: Json) -> T.DataType:
    p = _resolved(prop)
    kind = p.get("type")
    if "enum" in p:
        return T.StringType()
    if kind == "array":
        return T.ArrayType(spark_type(p.get("items") or {}))
    if kind == "object":
        if p.get("properties"):
            return T.StructType([T.StructField(k, spark_type(v)) for k, v in p["properties"].items()])
        return T.MapType(T.StringType(), T.StringType())
    return _SCALARS.get(kind, T.StringType())


def to_struct(schema: Json) -> T.StructType:
    """All fields are nullable: that a field is required only means that its key must be there."""
    flat = resolve_refs(schema)
    if not flat.get("properties"):
        raise SchemaError("the schema has no properties")
    return T.StructType([T.StructField(k, spark_type(v)) for k, v in flat["properties"].items()])


def from_struct(struct: T.StructType) -> Json:
    def one(t: T.DataType) -> Json:
        if isinstance(t, T.ArrayType):
            return {"type": "array", "items": one(t.elementType)}
        if isinstance(t, T.StructType):
            return dict(type="object", properties={f.name: one(f.dataType) for f in t.fields})
        if isinstance(t, T.MapType):
            return {"type": "object"}
        if isinstance(t, (T.IntegerType, T.ShortType, T.ByteType)):
            return {"type": "integer"}
        if isinstance(t, (T.FloatType, T.DecimalType)):
            return {"type": "number"}
        return {"type": _NAMES.get(t, "string")}

    return object_of(**{f.name: one(f.dataType) for f in struct.fields}) | {"required": sorted(f.name for f in struct.fields if not f.nullable)}


def required(schema: Json) -> list[str]:
    return [k for k in schema.get("required", []) if k in schema.get("properties", {})]


def string_fields(schema: Json) -> list[str]:
    """Fields of strings, or of arrays of them, by the type they are read as."""
    kinds = {name: spark_type(prop) for name, prop in resolve_refs(schema).get("properties", {}).items()}
    return [k for k, t in kinds.items() if isinstance(t.elementType if isinstance(t, T.ArrayType) else t, T.StringType)]


def leaf_fields(schema: Json) -> int:
    """Scalars, and arrays of scalars, in the schema; 1 without properties."""
    def count(p: Json) -> int:
        p = _resolved(p)
        if p.get("type") == "array":
            inner = _resolved(p.get("items") or {})
            return count(inner) if inner.get("type") == "object" and inner.get("properties") else 1
        if p.get("properties"):
            return sum(count(v) for v in p["properties"].values())
        return 1

    props = resolve_refs(schema).get("properties")
    return sum(count(v) for v in props.values()) if props else 1


def parse_schema(reply: str) -> Json:
    """A schema from a model's reply: fenced or not, bare or as the one value that has properties."""
    try:
        found = json.loads(strip_fences(reply))
    except ValueError as e:
        raise DiscoveryError(f"the reply isn't JSON: {e}") from e
    if not isinstance(found, dict):
        raise DiscoveryError("the reply isn't an object")
    if "properties" not in found:
        found = next((v for v in found.values() if isinstance(v, dict) and "properties" in v), None)
        if found is None:
            raise DiscoveryError("the reply has no properties")
    return {"type": "object", **found}


def apply_changes(schema: Json, changes: Json, strictly_additive: bool = False) -> Json:
    """Add missing fields, then (unless additive) remove and shallowly modify; never leaves a schema without fields."""
    out = copy.deepcopy(schema)
    props = out.setdefault("properties", {})
    need = set(out.get("required", []))
    for name, prop in (changes.get("add_fields") or {}).items():
        if isinstance(prop, dict):
            props.setdefault(name, prop)
    if not strictly_additive:
        for name in changes.get("remove_fields") or []:
            props.pop(name, None)
            need.discard(name)
        for name, prop in (changes.get("modify_fields") or {}).items():
            if name in props and isinstance(prop, dict):
                props[name] = {**props[name], **prop}
    if not props and schema.get("properties"):
        return copy.deepcopy(schema)
    if "required" in out:
        out["required"] = sorted(need)
    return out


def with_sources(schema: Json) -> Json:
    """The schema whose fields carry a value and the quotes it was taken from; doing it twice changes nothing."""
    props = schema.get("properties")
    if schema.get("type") != "object" or not props or schema.get(WRAPPED):
        return schema
    quotes = dict(type="array", items=dict(type="string"))
    wrapped = {k: object_of("value", "source_quotes", value=v, source_quotes=quotes) for k, v in props.items()}
    return {**schema, "properties": wrapped, WRAPPED: True}


def without_sources(record: Json) -> tuple[Json, dict[str, list[str]]]:
    """Values and quotes of a record of ``with_sources``; fields that aren't wrapped pass as they are."""
    values, quotes = {}, {}
    for k, v in record.items():
        if isinstance(v, dict) and "value" in v and "source_quotes" in v:
            values[k] = v["value"]
            said = v["source_quotes"]
            quotes[k] = [str(q) for q in said if q] if isinstance(said, list) else []
        else:
            values[k] = v
    return values, quotes


def diff(a: Json, b: Json) -> dict[str, list[str]]:
    x, y = a.get("properties", {}), b.get("properties", {})
    return {"added": sorted(y.keys() - x.keys()), "removed": sorted(x.keys() - y.keys()), "changed": sorted(k for k in x.keys() & y.keys() if x[k] != y[k])}
