"""Python-style type annotations as JSON Schema fragments.

The annotation is read as a Python expression and turned into a schema bottom-up: each kind of
expression node has one rule. Edge cases: a list of annotations is their union; anything that is no
known type name, generic or union raises AnnotationError; recursion that Python cannot parse does too.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Callable
from copy import deepcopy
from typing import Any

from callweave.jsonx import canonical

Schema = dict[str, Any]


class AnnotationError(ValueError):
    """An annotation or record that cannot be turned into the canonical form."""


# --- fixed values: type names and the schema that each means ------------------------------------
_TEXT, _WHOLE, _REAL, _TRUTH = {"type": "string"}, {"type": "integer"}, {"type": "number"}, {"type": "boolean"}
_OPEN_LIST, _OPEN_SET = {"type": "array", "items": {}}, {"type": "array", "items": {}, "uniqueItems": True}
_OPEN_MAP, _NULL = {"type": "object"}, {"type": "null"}
NAMES: dict[str, Schema] = {
    **dict.fromkeys(("str", "string", "text"), _TEXT),
    **dict.fromkeys(("int", "integer"), _WHOLE),
    **dict.fromkeys(("float", "double", "number"), _REAL),
    **dict.fromkeys(("bool", "boolean"), _TRUTH),
    **dict.fromkeys(("list", "array", "tuple"), _OPEN_LIST),
    **dict.fromkeys(("set", "frozenset"), _OPEN_SET),
    **dict.fromkeys(("dict", "dictionary", "mapping", "object"), _OPEN_MAP),
    **dict.fromkeys(("null", "none", "nonetype"), _NULL),
    "any": {},
}
OPTIONAL_MARK = re.compile(r",\s*optional\s*$", re.I)
DEFAULT_MARK = re.compile(r",\s*default\s+(?P<value>.+?)\s*$", re.I)
# --- end of fixed values -------------------------------------------------------------------------


def union(parts: list[Schema]) -> Schema:
    """One schema for several: equal ones once, integer within number, a single one as itself."""
    distinct = list({canonical(p): p for p in parts}.values())  # in the order of their first mention
    if _REAL in distinct:
        distinct = [p for p in distinct if p != _WHOLE]
    return distinct[0] if len(distinct) == 1 else {"anyOf": distinct}


def _one(name: str, args: list[ast.expr], wrap: Callable[[Schema], Schema]) -> Schema:
    if len(args) != 1:
        raise AnnotationError(f"{name} expects one type argument.")
    return wrap(_schema(args[0]))


def _fixed_tuple(name: str, args: list[ast.expr]) -> Schema:
    if not args:
        return deepcopy(_OPEN_LIST)
    if len(args) == 2 and isinstance(args[1], ast.Constant) and args[1].value is Ellipsis:
        return {"type": "array", "items": _schema(args[0])}
    members = [_schema(a) for a in args]
    same = all(m == members[0] for m in members)
    shape = {"items": members[0]} if same else {"prefixItems": members}
    return {"type": "array", **shape, "minItems": len(members), "maxItems": len(members)}


def _optional(name: str, args: list[ast.expr]) -> Schema:
    if len(args) != 1:
        raise AnnotationError("Optional expects exactly one type argument.")
    return union([_schema(args[0]), dict(_NULL)])


def _mapping(name: str, args: list[ast.expr]) -> Schema:
    return {"type": "object", "additionalProperties": _schema(args[-1]) if len(args) > 1 else {}}


def _sequence(name: str, args: list[ast.expr]) -> Schema:
    return _one(name, args, lambda item: {"type": "array", "items": item})


def _distinct(name: str, args: list[ast.expr]) -> Schema:
    return _one(name, args, lambda item: {"type": "array", "items": item, "uniqueItems": True})


GENERICS: dict[str, Callable[[str, list[ast.expr]], Schema]] = {
    **dict.fromkeys(("list", "array", "sequence"), _sequence),
    **dict.fromkeys(("set", "frozenset"), _distinct),
    **dict.fromkeys(("dict", "mapping"), _mapping),
    "tuple": _fixed_tuple,
    "union": lambda name, args: union([_schema(a) for a in args]),
    "optional": _optional,
}


def _label(node: ast.expr) -> str | None:
    match node:
        case ast.Name(id=name) | ast.Attribute(attr=name):
            return name
    return None


def _schema(node: ast.expr) -> Schema:
    match node:
        case ast.Name() | ast.Attribute():
            name = _label(node)
            if name.lower() not in NAMES:
                raise AnnotationError(f"Unsupported parameter type name: {name!r}.")
            return deepcopy(NAMES[name.lower()])
        case ast.Constant(value=None):
            return dict(_NULL)
        case ast.Constant(value=value):
            raise AnnotationError(f"Unsupported type constant: {value!r}.")
        case ast.BinOp(op=ast.BitOr(), left=left, right=right):
            return union([_schema(left), _schema(right)])
        case ast.Subscript(value=base, slice=inner):
            name = _label(base)
            if name is None:
                raise AnnotationError(f"Unsupported generic type: {ast.dump(base)}.")
            args = list(inner.elts) if isinstance(inner, ast.Tuple) else [inner]
            if name.lower() not in GENERICS:
                raise AnnotationError(f"Unsupported generic parameter type: {name!r}.")
            return GENERICS[name.lower()](name, args)
    raise AnnotationError(f"Unsupported type expression: {ast.dump(node)}.")


def compile_type(raw: Any) -> tuple[Schema, bool]:
    """The schema of an annotation and whether it carries the optional mark."""
    if isinstance(raw, list):
        parts = [compile_type(x) for x in raw]
        return union([p for p, _ in parts]), any(mark for _, mark in parts)
    if not isinstance(raw, str) or not raw.strip():
        raise AnnotationError(f"Parameter type must be a non-empty string; received {raw!r}.")
    text = DEFAULT_MARK.sub("", raw.strip()).strip()
    bare = OPTIONAL_MARK.sub("", text).strip()
    try:
        tree = ast.parse(bare, mode="eval")
    except (SyntaxError, RecursionError, MemoryError, ValueError) as e:
        raise AnnotationError(f"Invalid parameter type expression: {raw!r}.") from e
    return _schema(tree.body), bare != text


def annotated_default(raw: Any) -> tuple[bool, Any]:
    """Whether an annotation carries a default, and its value."""
    found = DEFAULT_MARK.search(raw.strip()) if isinstance(raw, str) else None
    if not found:
        return False, None
    try:
        return True, ast.literal_eval(found["value"].strip())
    except (SyntaxError, ValueError, RecursionError, MemoryError) as e:
        raise AnnotationError(f"Invalid annotated default value in type {raw!r}.") from e


def type_label(raw: Any) -> str | Schema:
    """The top-level JSON type where there is one, else the whole schema."""
    schema, _ = compile_type(raw)
    return schema["type"] if isinstance(schema.get("type"), str) else schema
