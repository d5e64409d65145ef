"""Checks of canonical records: tool schemas, arguments against them, estimated length.

All checks yield (category, message) and go on; a record's issues are the distinct ones in order.
Edge cases: a record whose tools are no list has that one issue and no length; a tool with a faulty
schema counts as unavailable to its calls; enum, ranges, lengths and patterns are not checked.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from typing import Any

from callweave.functions.annotations import AnnotationError
from callweave.functions.records import canonical_record, kind
from callweave.jsonx import canonical

Issue = tuple[str, str]
CONTEXT_LIMIT, CHARS_PER_TOKEN = 8192, 4

# --- fixed values: issue categories, JSON types and messages------------------------------------------
SCHEMA, UNREADABLE, UNAVAILABLE = "invalid_tool_schema", "unparseable_expected_calls", "unavailable_expected_tool"
ARGUMENTS, MISSING, INCOMPATIBLE = "invalid_argument_object", "missing_required_arguments", "incompatible_argument_type"
TOO_LONG, CROSS_SPLIT = "context_length_exceeded", "duplicate_cross_split"
TYPES: dict[str, tuple[type, ...]] = {
    "string": (str,), "integer": (int,), "number": (int, float), "boolean": (bool,), "array": (list,), "object": (dict,), "null": (type(None),),
}
MESSAGES = {
    "not_object": "{0} must be an object schema.",
    "no_arms": "{0}.anyOf must be a non-empty list.",
    "no_type": "{0} does not define a type.",
    "odd_type": "{0} has unsupported type {1!r}.",
    "prefix_list": "{0}.prefixItems must be a list.",
    "properties": "{0}.properties must be an object.",
    "required": "{0}.required must be a list of strings.",
    "additional": "{0}.additionalProperties must be a schema or boolean.",
    "no_arm_fits": "{0} has incompatible type {1}.",
    "other_type": "{0} expects {1} but received {2}.",
    "key_missing": "{0}.{1} is required.",
    "tool_object": "{0} must be an object.",
    "tool_function": "{0}.function must be an object.",
    "tool_name": "{0} has no valid function name.",
    "tool_twice": "Duplicate tool name {0!r} is present.",
    "call_payload": "tool_call {0} has no valid function payload.",
    "call_name": "tool_call {0} has no valid function name.",
    "call_unknown": "tool_call {0} references unavailable tool {1!r}.",
    "call_arguments": "tool_call {0} arguments must be an object; received {1}.",
    "tools_list": "Normalized tools must be a list.",
    "calls_list": "Assistant tool_calls must be a list.",
    "too_long": "Estimated rendered sequence length {0} tokens exceeds target context limit {1}.",
}
# --- end of fixed values -------------------------------------------------------------------------


def _say(name: str, *about: Any) -> str:
    return MESSAGES[name].format(*about)


def fits(declared: str, value: Any) -> bool:
    """Whether a value has a declared JSON type; unknown types fit everything."""
    if declared not in TYPES:
        return True
    return isinstance(value, TYPES[declared]) and (declared == "boolean" or not isinstance(value, bool))


def schema_issues(schema: Any, path: str) -> Iterator[Issue]:
    """Faults of a schema and all schemas in it."""
    if not isinstance(schema, dict):
        yield SCHEMA, _say("not_object", path)
        return
    if "anyOf" in schema:
        arms = schema["anyOf"]
        if not isinstance(arms, list) or not arms:
            yield SCHEMA, _say("no_arms", path)
        else:
            for i, arm in enumerate(arms):
                yield from schema_issues(arm, f"{path}.anyOf[{i}]")
        return
    declared = schema.get("type")
    if declared is None:
        yield SCHEMA, _say("no_type", path)
    elif not isinstance(declared, str) or declared not in TYPES:
        yield SCHEMA, _say("odd_type", path, declared)
    elif declared == "object":
        yield from _object_schema_issues(schema, path)
    elif declared == "array":
        if schema.get("items") is not None:
            yield from schema_issues(schema["items"], f"{path}.items")
        first = schema.get("prefixItems")
        if isinstance(first, list):
            for i, child in enumerate(first):
                yield from schema_issues(child, f"{path}.prefixItems[{i}]")
        elif first is not None:
            yield SCHEMA, _say("prefix_list", path)


def _object_schema_issues(schema: dict, path: str) -> Iterator[Issue]:
    children = schema.get("properties", {})
    if isinstance(children, dict):
        for name, child in children.items():
            yield from schema_issues(child, f"{path}.properties.{name}")
    else:
        yield SCHEMA, _say("properties", path)
    required = schema.get("required")
    if required is not None and not (isinstance(required, list) and all(isinstance(x, str) for x in required)):
        yield SCHEMA, _say("required", path)
    more = schema.get("additionalProperties")
    if isinstance(more, dict):
        yield from schema_issues(more, f"{path}.additionalProperties")
    elif more is not None and not isinstance(more, bool):
        yield SCHEMA, _say("additional", path)


def value_issues(value: Any, schema: dict, path: str) -> Iterator[Issue]:
    """Where a value departs from its schema."""
    if "anyOf" in schema:
        arms = [a for a in schema["anyOf"] if isinstance(a, dict)]
        if all(any(True for _ in value_issues(value, arm, path)) for arm in arms):
            yield INCOMPATIBLE, _say("no_arm_fits", path, kind(value))
        return
    declared = schema.get("type")
    if isinstance(declared, str) and not fits(declared, value):
        yield INCOMPATIBLE, _say("other_type", path, declared, kind(value))
    elif declared == "object" and isinstance(value, dict):
        for key in schema.get("required") or []:
            if key not in value:
                yield MISSING, _say("key_missing", path, key)
        children = schema.get("properties", {})
        children = children if isinstance(children, dict) else {}
        more = schema.get("additionalProperties")
        known = [(k, c) for k, c in children.items() if k in value and isinstance(c, dict)]
        other = [(k, more) for k in value if k not in children] if isinstance(more, dict) else []
        for key, child in known + other:
            yield from value_issues(value[key], child, f"{path}.{key}")
    elif declared == "array" and isinstance(value, list):
        first = schema.get("prefixItems")
        first = first if isinstance(first, list) else []
        rest = schema.get("items")
        for i, item in enumerate(value):
            child = first[i] if i < len(first) else rest
            if isinstance(child, dict):
                yield from value_issues(item, child, f"{path}[{i}]")


def estimated_tokens(record: dict) -> int:
    return max(1, math.ceil(len(canonical({"tools": record["tools"], "messages": record["messages"]})) / CHARS_PER_TOKEN))


def _tool_issues(tools: list, ready: dict[str, dict]) -> Iterator[Issue]:
    for i, tool in enumerate(tools):
        at = f"tools[{i}]"
        if not isinstance(tool, dict):
            yield SCHEMA, _say("tool_object", at)
            continue
        body = tool.get("function")
        if not isinstance(body, dict):
            yield SCHEMA, _say("tool_function", at)
            continue
        name = body.get("name")
        if not isinstance(name, str) or not name.strip():
            yield SCHEMA, _say("tool_name", at)
        elif name in ready:
            yield SCHEMA, _say("tool_twice", name)
        else:
            faults = list(schema_issues(body.get("parameters"), f"{at}.function.parameters"))
            yield from faults
            if not faults:
                ready[name] = body["parameters"]


def _call_issues(calls: list, ready: dict[str, dict]) -> Iterator[Issue]:
    for i, call in enumerate(calls, 1):
        body = call.get("function") if isinstance(call, dict) else None
        if not isinstance(body, dict):
            yield UNREADABLE, _say("call_payload", i)
            continue
        name, args = body.get("name"), body.get("arguments")
        if not isinstance(name, str) or not name.strip():
            yield UNREADABLE, _say("call_name", i)
        elif name not in ready:
            yield UNAVAILABLE, _say("call_unknown", i, name)
        elif not isinstance(args, dict):
            yield ARGUMENTS, _say("call_arguments", i, kind(args))
        else:
            yield from value_issues(args, ready[name], f"{name}.arguments")


def record_issues(record: dict, limit: int = CONTEXT_LIMIT) -> tuple[list[Issue], int | None]:
    """Distinct issues of a canonical record in order, and its estimated tokens."""
    tools, messages = record.get("tools"), record.get("messages")
    if not isinstance(tools, list):
        return [(SCHEMA, _say("tools_list"))], None
    ready: dict[str, dict] = {}
    issues = list(_tool_issues(tools, ready))
    turn = messages[1] if isinstance(messages, list) and len(messages) > 1 else None
    calls = turn.get("tool_calls") if isinstance(turn, dict) else None
    if isinstance(calls, list):
        issues += _call_issues(calls, ready)
    else:
        issues.append((UNREADABLE, _say("calls_list")))
    tokens = estimated_tokens(record)
    if tokens > limit:
        issues.append((TOO_LONG, _say("too_long", tokens, limit)))
    return list(dict.fromkeys(issues)), tokens


def failure_issue(message: str) -> Issue:
    """The issue that a failure to build the canonical record counts as; the first rule that applies."""
    low = message.lower()
    rules = (
        ("references unavailable tool" in low, UNAVAILABLE),
        ("arguments for call" in low and ("invalid json" in low or "must be an object" in low), ARGUMENTS),
        ("answers" in low or "answer " in low, UNREADABLE),
    )
    return next((c for holds, c in rules if holds), SCHEMA), message


def raw_issues(row: dict, split: str, limit: int = CONTEXT_LIMIT) -> tuple[list[Issue], int | None]:
    """Issues of a raw row: the failure to build its record, or those of the record."""
    try:
        record = canonical_record(row, split)
    except AnnotationError as e:
        return [failure_issue(str(e))], None
    return record_issues(record, limit)
