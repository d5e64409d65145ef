"""One raw tool-calling row (id, query, tools, answers) as a canonical chat record.

Edge cases: any failure raises AnnotationError with a message that names the row and the cause;
fields are checked in the order id, query, tools, answers, tools one by one, duplicate names, calls
one by one, so the first failure is the one that is reported. Null arguments mean no arguments.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Any

from callweave.functions.annotations import AnnotationError, annotated_default, compile_type

# --- fixed values: version, generator boundary, keywords that a parameter may set itself, and messages -----
SCHEMA_VERSION = "1.0"
GENERATOR_BOUNDARY = 33_659
KEYWORDS = ("enum", "default", "format", "minimum", "maximum", "exclusiveMinimum", "exclusiveMaximum", "minLength", "maxLength", "minItems", "maxItems", "pattern")
MESSAGES = {
    "missing": "Missing required fields: {0}.",
    "id": "invalid id: {0}",
    "field_type": "Row {row}: {0} must be a JSON string, list, or dictionary; received {1}.",
    "field_json": "Row {row}: {0} contains invalid JSON. Preview: {1!r}",
    "field_list": "Row {row}: {0} must be a non-empty list.",
    "query": "Row {row}: query must be a non-empty string.",
    "parameter_object": "Parameter {0!r} must be an object; received {1}.",
    "parameter_type": "Parameter {0!r} does not define a type.",
    "parameters": "Function parameters must be a dictionary.",
    "tool_object": "Row {row}: tool must be an object.",
    "tool_name": "Row {row}: tool has no valid name.",
    "tool_twice": "Row {row}: duplicate tool names are present.",
    "call_object": "Row {row}: answer {0} must be an object.",
    "call_name": "Row {row}: answer {0} has no valid tool name.",
    "call_unknown": "Row {row}: answer {0} references unavailable tool {1!r}.",
    "arguments_json": "Row {row}: arguments for call {0} contain invalid JSON.",
    "arguments_object": "Row {row}: arguments for call {0} must be an object; received {1}.",
}
# --- end of fixed values -----------------------------------------------------------------------------------


def fault(name: str, *about: Any, row: Any = None) -> AnnotationError:
    return AnnotationError(MESSAGES[name].format(*about, row=row))


def kind(value: Any) -> str:
    return type(value).__name__


def decode_field(value: Any, field: str, row_id: Any) -> Any:
    """A JSON text decoded; a list or object passes."""
    match value:
        case list() | dict():
            return value
        case str():
            try:
                return json.loads(value)
            except (ValueError, RecursionError) as e:
                raise fault("field_json", field, value[:200], row=row_id) from e
    raise fault("field_type", field, kind(value), row=row_id)


# A schema is put together from what its rules yield: (keyword, value) pairs, later ones over earlier ones.
Parts = Iterator[tuple[str, Any]]


def _annotated(raw: dict, name: str, out: dict) -> Parts:
    given, value = annotated_default(raw["type"])
    if given:
        yield "default", value
    if isinstance(raw.get("description"), str) and raw["description"].strip():
        yield "description", raw["description"].strip()
    yield from ((k, raw[k]) for k in KEYWORDS if k in raw)


def _members(raw: dict, name: str, out: dict) -> Parts:
    match raw.get("items"):
        case dict() as declared:
            yield "items", parameter_schema(declared, f"{name}[]")
        case str() as annotation:
            yield "items", compile_type(annotation)[0]
        case _:
            yield "items", out.get("items", {})


def _uniqueness(raw: dict, name: str, out: dict) -> Parts:
    if "uniqueItems" in raw:
        yield "uniqueItems", bool(raw["uniqueItems"])


def _children(raw: dict, name: str, out: dict) -> Parts:
    children = raw.get("properties")
    if isinstance(children, dict):
        yield from object_parts(children, f"{name}.", raw.get("required"))


def _others(raw: dict, name: str, out: dict) -> Parts:
    if "additionalProperties" in raw:
        more = raw["additionalProperties"]
        yield "additionalProperties", parameter_schema(more, f"{name}.*") if isinstance(more, dict) else more


#: The rules of a declaration by the JSON type of its annotation.
RULES = {"array": (_annotated, _members, _uniqueness), "object": (_annotated, _children, _others)}


def object_parts(children: dict, prefix: str, listed: Any = None) -> Parts:
    """The properties of an object, and which it requires: those that say so themselves and those that are listed."""
    yield "properties", {str(k): parameter_schema(v, f"{prefix}{k}") for k, v in children.items()}
    required = {str(k) for k, v in children.items() if isinstance(v, dict) and v.get("required") is True} | set(map(str, listed if isinstance(listed, list) else ()))
    if required:
        yield "required", sorted(required)


def parameter_schema(raw: Any, name: str) -> dict[str, Any]:
    """JSON Schema of one declared parameter: its annotation, then the rules for what that says it is."""
    if not isinstance(raw, dict):
        raise fault("parameter_object", name, kind(raw))
    if raw.get("type") is None:
        raise fault("parameter_type", name)
    out = compile_type(raw["type"])[0]
    for rule in RULES.get(str(out.get("type")), (_annotated,)):
        out.update(rule(raw, name, out))
    return out


def parameters_schema(raw: Any) -> dict[str, Any]:
    """JSON Schema of a tool's parameters: a flat map of declarations, or already an object schema."""
    match raw:
        case None:
            return parameters_schema({})
        case {"type": "object", "properties": dict()}:
            return parameter_schema(raw, "<parameters>")
        case dict():
            return {"type": "object", **dict(object_parts(raw, ""))}
    raise fault("parameters")


def _name(body: Any) -> str:
    name = body.get("name") if isinstance(body, dict) else None
    return name.strip() if isinstance(name, str) else ""


def canonical_tool(raw: Any, row_id: Any) -> dict[str, Any]:
    if not isinstance(raw, dict):
        raise fault("tool_object", row=row_id)
    body = raw["function"] if isinstance(raw.get("function"), dict) else raw
    if not (name := _name(body)):
        raise fault("tool_name", row=row_id)
    about = body.get("description")
    return {"type": "function", "function": {"name": name, "description": "" if about is None else str(about), "parameters": parameters_schema(body.get("parameters"))}}


def call_arguments(args: Any, row_id: Any, number: int) -> dict[str, Any]:
    """The arguments of a call: an object, its JSON text, or nothing."""
    if isinstance(args, str):
        try:
            args = json.loads(args)
        except (ValueError, RecursionError) as e:
            raise fault("arguments_json", number, row=row_id) from e
    if args is not None and not isinstance(args, dict):
        raise fault("arguments_object", number, kind(args), row=row_id)
    return args or {}


def canonical_call(raw: Any, row_id: Any, number: int, known: set[str]) -> dict[str, Any]:
    name = _name(raw)
    checks = (("call_object", isinstance(raw, dict)), ("call_name", bool(name)), ("call_unknown", name in known))
    if failed := next((check for check, holds in checks if not holds), None):
        raise fault(failed, number, name, row=row_id)
    return {"id": f"call_{number}", "type": "function", "function": {"name": name, "arguments": call_arguments(raw.get("arguments"), row_id, number)}}


def lists_of(row: dict[str, Any]) -> tuple[int, str, list, list]:
    """Checked id, query, tools and answers of a raw row."""
    if missing := sorted({"id", "query", "tools", "answers"} - set(row)):
        raise fault("missing", missing)
    try:
        row_id = int(row["id"])
    except (TypeError, ValueError) as e:
        raise fault("id", e) from e
    query = row["query"]
    if not isinstance(query, str) or not query.strip():
        raise fault("query", row=row_id)
    lists = {f: decode_field(row[f], f, row_id) for f in ("tools", "answers")}
    for f, value in lists.items():
        if not isinstance(value, list) or not value:
            raise fault("field_list", f, row=row_id)
    return row_id, query, lists["tools"], lists["answers"]


def canonical_record(row: dict[str, Any], split: str, source_dataset: str = "fc", prefix: str = "fc", boundary: int = GENERATOR_BOUNDARY) -> dict[str, Any]:
    """The canonical record of a raw row."""
    row_id, query, raw_tools, raw_answers = lists_of(row)
    tools = [canonical_tool(t, row_id) for t in raw_tools]
    known = {t["function"]["name"] for t in tools}
    if len(known) < len(tools):
        raise fault("tool_twice", row=row_id)
    calls = [canonical_call(a, row_id, i, known) for i, a in enumerate(raw_answers, 1)]
    return {
        "schema_version": SCHEMA_VERSION,
        "id": f"{prefix}-{row_id}",
        "tools": tools,
        "messages": [{"role": "user", "content": query.strip()}, {"role": "assistant", "content": "", "tool_calls": calls}],
        "metadata": {
            "source_dataset": source_dataset, "source_id": row_id, "split": split,
            "generator": "deepseek" if row_id < boundary else "mixtral",
            "available_tool_count": len(tools), "expected_call_count": len(calls),
        },
    }


def expected_calls(record: dict[str, Any]) -> list[dict[str, Any]]:
    """Names and arguments of all calls of a record."""
    return [{"name": c["function"]["name"], "arguments": c["function"]["arguments"]} for m in record.get("messages") or [] for c in m.get("tool_calls") or []]


def complex_parameters(record: dict[str, Any]) -> bool:
    """Whether any parameter holds an array, an object or alternatives, at any depth."""
    todo: list[Any] = [p for t in record.get("tools") or [] for p in ((t.get("function") or {}).get("parameters") or {}).get("properties", {}).values()]
    while todo:
        node = todo.pop()
        if isinstance(node, dict):
            declared = node.get("type")
            if "anyOf" in node or (isinstance(declared, str) and declared in ("array", "object")):
                return True
            todo.extend(node.values())
        elif isinstance(node, list):
            todo.extend(node)
    return False
