"""Conformance of JSON documents to a JSON schema (T8), as one expression.

The schema is walked once and becomes one SQL expression over a VARIANT value;
applied to a column of documents it gives every violation. Known
keywords: ``type`` (one or several), ``enum``, ``required``, ``properties``,
``additionalProperties`` (a schema) and ``items``; others are annotations.
Objects and arrays of any depth are checked where they stand, arrays element
by element; no document is collected and no rule is tried twice.

A violation is (path, rule, value): where (``results.files[].name``, ``*`` for
a property that the schema does not name), which rule (``type``, ``enum``,
``required``, or ``json`` for a document that can not be parsed) and the kind
or value found there (null where a required property is missing).

Defined cases: a null document is not JSON; a property that is missing is only
checked for ``required``; below a value of a wrong type nothing is checked;
``integer`` takes numbers without a fraction, as JSON schema does.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

VIOLATIONS = "array<struct<path:string,rule:string,value:string>>"


def rules(schema: dict, path: str = "") -> Iterator[tuple[str, str, object]]:
    """(path, rule, argument) of every check of a schema, in its order."""
    if "type" in schema:
        yield path, "type", schema["type"]
    if "enum" in schema:
        yield path, "enum", schema["enum"]
    for name in schema.get("required", ()):
        yield f"{path}.{name}".lstrip("."), "required", None
    for name, sub in schema.get("properties", {}).items():
        yield from rules(sub, f"{path}.{name}".lstrip("."))
    if isinstance(schema.get("additionalProperties"), dict):
        yield from rules(schema["additionalProperties"], f"{path}.*".lstrip("."))
    if "items" in schema:
        yield from rules(schema["items"], f"{path}[]")


def subschema(schema: dict, path: str) -> dict:
    """The schema that holds at a path (``results.files[]``)."""
    for part in path.replace("[]", ".[]").strip(".").split("."):
        if part == "[]":
            schema = schema["items"]
        else:
            schema = schema.get("properties", {}).get(part) or schema["additionalProperties"]
    return schema


# fixed values: JSON types of a VARIANT's types
_KINDS = {"VOID": "null", "OBJECT": "object", "ARRAY": "array", "STRING": "string", "BOOLEAN": "boolean",
          "TINYINT": "integer", "SMALLINT": "integer", "INT": "integer", "BIGINT": "integer"}
_NONE = f"cast(array() AS {VIOLATIONS})"


def _text(value: str) -> str:
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def _get(v: str, name: str) -> str:
    quote = '"' if "'" in name else "'"
    return f"try_variant_get({v}, {_text(f'$[{quote}{name}{quote}]')}, 'variant')"


def _one(path: str, rule: str, value: str = "NULL") -> str:
    return (f"array(named_struct('path', {_text(path)}, 'rule', {_text(rule)}, "
            f"'value', cast({value} AS string)))")


def _kind(v: str) -> str:
    """JSON type of a VARIANT: ``integer`` for numbers without a fraction."""
    cases = " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in _KINDS.items())
    number = f"try_variant_get({v}, '$', 'double')"
    return (f"CASE regexp_extract(schema_of_variant({v}), '^[A-Z]+', 0) {cases} "
            f"ELSE if({number} = rint({number}), 'integer', 'number') END")


def _violations_sql(schema: dict, path: str, v: str, depth: int = 0) -> str:
    """SQL for the array of violations of the value ``v``; none where it is
    null (not there). ``v`` and its kind are computed once, as lambda arguments."""
    x, kind, entry = f"x{depth}", f"k{depth}", f"e{depth}"
    deeper = lambda sub, at, inner: _violations_sql(sub, at, inner, depth + 1)
    below = lambda name: f"{path}.{name}".lstrip(".")
    found = []
    if "enum" in schema:
        allowed = ", ".join(_text(json.dumps(value, separators=(",", ":"))) for value in schema["enum"])
        found.append(f"if(to_json({x}) IN ({allowed}), {_NONE}, "
                     + _one(path, "enum", f"try_variant_get({x}, '$', 'string')") + ")")
    for name in schema.get("required", ()):
        found.append(f"if({_get(x, name)} IS NULL, {_one(below(name), 'required')}, {_NONE})")
    named = schema.get("properties", {})
    found += [deeper(sub, below(name), _get(x, name)) for name, sub in named.items()]
    if isinstance(schema.get("additionalProperties"), dict):
        entries = f"map_entries(try_variant_get({x}, '$', 'map<string,variant>'))"
        if named:
            entries = f"filter({entries}, {entry} -> {entry}.key NOT IN ({', '.join(map(_text, named))}))"
        inner = deeper(schema["additionalProperties"], below("*"), f"{entry}.value")
        found.append(f"coalesce(flatten(transform({entries}, {entry} -> {inner})), {_NONE})")
    if "items" in schema:
        inner = deeper(schema["items"], f"{path}[]", entry)
        found.append(f"coalesce(flatten(transform(try_variant_get({x}, '$', 'array<variant>'), "
                     f"{entry} -> {inner})), {_NONE})")
    body = f"flatten(array({', '.join(found)}))" if found else _NONE
    types = schema.get("type")
    if types is not None:
        types = [types] if isinstance(types, str) else list(types)
        allowed = ", ".join(map(_text, types + ["integer"] * ("number" in types)))
        body = (f"flatten(transform(array({_kind(x)}), {kind} -> "
                f"if({kind} IN ({allowed}), {body}, {_one(path, 'type', kind)})))")
    return f"flatten(transform(array({v}), {x} -> if({x} IS NULL, {_NONE}, {body})))"


def violations(docs: DataFrame, schema: dict, document: str = "document", at: str = "") -> DataFrame:
    """The other columns of ``docs`` and path, rule, value: one row per
    violation of the JSON text in ``document``, which stands at path ``at`` of
    the schema (the whole document by default)."""
    check = _violations_sql(subschema(schema, at) if at else schema, at, "_v")
    keys = [c for c in docs.columns if c != document]
    parsed = docs.select(*keys, F.try_parse_json(document).alias("_v"))
    # a JSON null is a value: only text that is no JSON gives none
    found = F.expr(f"if(_v IS NULL, {_one(at, 'json')}, {check})")
    return parsed.select(*keys, F.explode(found).alias("_x")).select(*keys, "_x.path", "_x.rule", "_x.value")
