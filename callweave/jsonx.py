"""Strict JSON decoding and canonical encoding, shared by the Arrow stages."""

from __future__ import annotations

import json
import re
import sys
from typing import Any

if hasattr(sys, "set_int_max_str_digits"):
    sys.set_int_max_str_digits(0)  # long numbers are standard JSON

BAD = object()


def _refuse(token: str) -> None:
    raise ValueError(f"{token} is not standard JSON")


_strict = json.JSONDecoder(parse_constant=_refuse)
_lenient = json.JSONDecoder()

_STRING = re.compile(r'"(?:[^"\\\x00-\x1f]|\\(?:["\\/bfnrt]|u[0-9a-fA-F]{4}))*"')
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][+-]?[0-9]+)?")
_WORD = re.compile(r"true|false|null")
_BLANK = re.compile(r"[ \t\n\r]*")


def loads_strict(text: str) -> Any:
    """Decode standard JSON: no NaN/Infinity, nothing after the end. Raises ValueError."""
    try:
        value, end = _strict.raw_decode(text, _BLANK.match(text).end())
    except RecursionError as e:
        raise ValueError("nested too deeply to decode") from e
    if _BLANK.match(text, end).end() != len(text):
        raise ValueError("text after the end")
    return value


def try_loads(text: str | None) -> Any:
    """The decoded value, or BAD."""
    if text is None:
        return BAD
    try:
        return loads_strict(text)
    except ValueError:
        return BAD


def is_json_deep(text: str) -> tuple[bool, bool]:
    """Iterative check for texts nested beyond the decoder: (standard JSON, a non-empty array of objects only)."""
    pos, stack, want, top, kinds = _BLANK.match(text).end(), [], "value", "", set()
    while True:
        if want == "value":
            c = text[pos : pos + 1]
            if len(stack) == 1 and stack[0] == "[":
                kinds.add("{" if c == "{" else "other")
            top = top or c
            if c and c in "[{":
                pos = _BLANK.match(text, pos + 1).end()
                if text[pos : pos + 1] == {"[": "]", "{": "}"}[c]:
                    if len(stack) == 0:
                        kinds.clear()
                    pos, want = pos + 1, "after"
                else:
                    if len(stack) == 0:
                        kinds.clear()
                    stack.append(c)
                    want = "key" if c == "{" else "value"
                    continue
            else:
                m = (_STRING if c == '"' else _WORD if c and c in "tfn" else _NUMBER).match(text, pos)
                if not m:
                    return False, False
                pos, want = m.end(), "after"
        elif want == "key":
            m = _STRING.match(text, pos)
            if not m:
                return False, False
            pos = _BLANK.match(text, m.end()).end()
            if text[pos : pos + 1] != ":":
                return False, False
            pos, want = _BLANK.match(text, pos + 1).end(), "value"
            continue
        pos = _BLANK.match(text, pos).end()
        if not stack:
            return pos == len(text), pos == len(text) and top == "[" and kinds == {"{"}
        c, pos = text[pos : pos + 1], pos + 1
        if c == ",":
            pos, want = _BLANK.match(text, pos).end(), "key" if stack[-1] == "{" else "value"
        elif c == {"[": "]", "{": "}"}[stack[-1]]:
            stack.pop()
            want = "after"
        else:
            return False, False


def canonical(value: Any) -> str:
    """Compact JSON with sorted keys, characters kept: equal values give equal text."""
    return json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":"))


def fold_numbers(value: Any) -> Any:
    """Let 1, 1.0 and (as Python compares them) True become one value, so that canonical texts compare as values do."""
    if isinstance(value, bool):
        return int(value)
    if isinstance(value, float):
        return int(value) if value.is_integer() else value
    if isinstance(value, dict):
        return {k: fold_numbers(v) for k, v in value.items()}
    if isinstance(value, list):
        return [fold_numbers(v) for v in value]
    return value


def decode_end(text: str, start: int) -> tuple[Any, int]:
    """Decode one JSON value (Python's dialect) at start; returns it and where it ends. Raises ValueError."""
    try:
        return _lenient.raw_decode(text, start)
    except RecursionError as e:
        raise ValueError("nested too deeply to decode") from e
