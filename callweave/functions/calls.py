"""Reading tool calls out of model output, and scoring them against expected calls.

Parsed calls are (name or None, arguments or None). Edge cases: empty output and output without JSON
have an error and no calls; a faulty call is kept with its error; null arguments are an error here.
The unordered match finds, among all assignments of greatest total weight, the first in the order
"unmatched before predicted 0 before predicted 1 ..." for expected 0, then expected 1, and so on; it is
found by an assignment algorithm of cubic cost, so long call lists are no trouble.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from typing import Any

from callweave.jsonx import decode_end

#: Keys under which call lists are wrapped, in the order in which they are looked for.
WRAPPERS = ("tool_calls", "calls", "parallel_calls", "parallel_tool_calls", "function_calls")
FLAGS = ("correct_function_name", "correct_argument_names", "correct_argument_values", "complete_call_match")


@dataclass(frozen=True)
class Call:
    name: str | None = None
    arguments: dict[str, Any] | None = None


@dataclass(frozen=True)
class Parsed:
    calls: tuple[Call, ...] = ()
    valid_structure: bool = False
    errors: tuple[str, ...] = ()
    had_extra_prose: bool = False


@dataclass(frozen=True)
class Score:
    valid_structure: bool = False
    correct_function_name: bool = False
    correct_argument_names: bool = False
    correct_argument_values: bool = False
    complete_call_match: bool = False
    parse_errors: tuple[str, ...] = ()

    @property
    def weight(self) -> int:
        return 1000 * self.complete_call_match + 100 * self.correct_argument_values + 10 * self.correct_argument_names + self.correct_function_name


@dataclass(frozen=True)
class SetScore(Score):
    predicted_count: int = 0
    expected_count: int = 0
    call_scores: tuple[Score, ...] = field(default=())
    order_matters: bool = False


def fragments(text: str) -> list[tuple[int, int, Any]]:
    """(start, end, value) of the JSON objects and arrays in a text, from the left, none inside another."""
    out, at = [], 0
    while True:
        opens = [i for i in (text.find("{", at), text.find("[", at)) if i >= 0]
        if not opens:
            return out
        start = min(opens)
        try:
            value, at = decode_end(text, start)
            out.append((start, at, value))
        except ValueError:
            at = start + 1


def _one_call(payload: Any, path: str, errors: list[str]) -> list[Call]:
    if not isinstance(payload, dict):
        errors.append(f"{path} must be an object.")
        return []
    if isinstance(payload.get("function"), dict):
        payload, path = payload["function"], f"{path}.function"
    name = payload.get("name")
    name = name.strip() if isinstance(name, str) else ""
    if not name:
        errors.append(f"{path}.name must be a non-empty string.")
    args = payload.get("arguments")
    if "arguments" not in payload:
        errors.append(f"{path}.arguments is missing.")
    else:
        fault = "must be a JSON object"
        if isinstance(args, str):
            try:
                args = json.loads(args)
            except (ValueError, RecursionError):
                args, fault = None, "contains invalid JSON"
        if not isinstance(args, dict):
            args = None
            errors.append(f"{path}.arguments {fault}.")
    return [Call(name or None, args)]


def _collect(payload: Any, path: str, errors: list[str]) -> list[Call]:
    """The calls of a payload in order; with a list of what is still to visit, so that nesting of any depth is read."""
    calls: list[Call] = []
    todo = [(payload, path)]
    while todo:
        payload, path = todo.pop()
        match payload:
            case Call():
                calls.append(payload)
            case list():
                todo += [(x, f"{path}[{i}]") for i, x in enumerate(payload)][::-1]
            case dict():
                wrapper = next((k for k in WRAPPERS if k in payload), None)
                if wrapper:
                    todo.append((payload[wrapper], f"{path}.{wrapper}"))
                else:
                    calls += _one_call(payload, path, errors)
            case _:
                errors.append(f"{path} must be a JSON object or list.")
    return calls


def parse_calls(value: Any) -> Parsed:
    """Calls in model output: text, or a decoded object or list."""
    errors: list[str] = []
    prose = False
    if isinstance(value, str):
        text = value.strip()
        parts = fragments(text)
        if not parts:
            return Parsed(errors=("No JSON object or array found in model output." if text else "Model output is empty.",))
        calls = [c for i, (_, _, x) in enumerate(parts) for c in _collect(x, f"fragment[{i}]", errors)]
        edges = [0, *(e for s, t, _ in parts for e in (s, t)), len(text)]
        prose = any(text[a:b].strip() for a, b in zip(edges[::2], edges[1::2]))
    else:
        calls = _collect(value, "root", errors)
    return Parsed(tuple(calls), bool(calls) and not errors, tuple(dict.fromkeys(errors)), prose)


def _as_parsed(value: Any) -> Parsed:
    return value if isinstance(value, Parsed) else parse_calls(value)


def compare(predicted: Call, expected: Call, valid: bool = True, errors: tuple[str, ...] = ()) -> Score:
    """The flags of one predicted call against one expected call."""
    readable = predicted.arguments is not None and expected.arguments is not None
    named = predicted.name is not None and expected.name is not None
    structure = valid and readable and named
    name = named and predicted.name == expected.name
    keys = readable and predicted.arguments.keys() == expected.arguments.keys()
    values = readable and predicted.arguments == expected.arguments
    return Score(structure, name, keys, values, structure and name and keys and values, errors)


def score_call(predicted: Any, expected: Any) -> Score:
    """One call against one call; anything but exactly one on each side scores nothing."""
    p, e = _as_parsed(predicted), _as_parsed(expected)
    errors = p.errors + e.errors
    if len(p.calls) != 1 or len(e.calls) != 1:
        return Score(parse_errors=(*errors, "score_call expects exactly one predicted and one expected call."))
    return compare(p.calls[0], e.calls[0], p.valid_structure and e.valid_structure, errors)


def _best_total(weights: list[list[int]]) -> int:
    """Greatest total of an assignment of rows to distinct columns, rows may stay free (shortest augmenting paths)."""
    rows, cols = len(weights), len(weights[0]) if weights else 0
    if not rows or not cols:
        return 0
    cols += rows  # a free column for each row
    cost = [[-w for w in r] + [0] * rows for r in weights]
    u, v, match = [0] * (rows + 1), [0] * (cols + 1), [0] * (cols + 1)
    for i in range(1, rows + 1):
        match[0], j0 = i, 0
        least, way, done = [float("inf")] * (cols + 1), [0] * (cols + 1), [False] * (cols + 1)
        while match[j0]:
            done[j0] = True
            r, step, j1 = match[j0], float("inf"), 0
            for j in range(1, cols + 1):
                if not done[j]:
                    c = cost[r - 1][j - 1] - u[r] - v[j]
                    if c < least[j]:
                        least[j], way[j] = c, j0
                    if least[j] < step:
                        step, j1 = least[j], j
            for j in range(cols + 1):
                if done[j]:
                    u[match[j]] += step
                    v[j] -= step
                else:
                    least[j] -= step
            j0 = j1
        while j0:
            match[j0], j0 = match[way[j0]], way[j0]
    return -sum(cost[match[j] - 1][j - 1] for j in range(1, cols + 1) if match[j])


def assign(weights: list[list[int]]) -> list[int | None]:
    """For each row its column or None: the first assignment, in the module's order, of greatest total."""
    out: list[int | None] = []
    free = list(range(len(weights[0]) if weights else 0))
    need = _best_total(weights)
    for i, row in enumerate(weights):
        rest = weights[i + 1 :]

        def total(columns: list[int]) -> int:
            return _best_total([[r[c] for c in columns] for r in rest])  # noqa: B023

        choice: int | None = None
        if total(free) < need:
            choice = next(c for c in free if row[c] and row[c] + total([x for x in free if x != c]) == need)
            free.remove(choice)
            need -= row[choice]
        out.append(choice)
    return out


def score_calls(predicted: Any, expected: Any, order_matters: bool = False) -> SetScore:
    """All calls against all expected calls, in order or as a set."""
    p, e = _as_parsed(predicted), _as_parsed(expected)
    basis = {"predicted_count": len(p.calls), "expected_count": len(e.calls), "parse_errors": p.errors + e.errors, "order_matters": order_matters}
    if not (p.valid_structure and e.valid_structure):
        return SetScore(**basis)
    same_count = len(p.calls) == len(e.calls)
    if order_matters:
        scores = tuple(compare(a, b) for a, b in zip(p.calls, e.calls)) if same_count else ()
    else:
        table = [[compare(a, b) for a in p.calls] for b in e.calls]
        chosen = assign([[s.weight for s in row] for row in table])
        missing = Score(parse_errors=("Expected call has no predicted match.",))
        scores = tuple(missing if c is None else row[c] for row, c in zip(table, chosen))
    flags = {f: same_count and bool(scores) and all(getattr(s, f) for s in scores) for f in FLAGS}
    return SetScore(valid_structure=True, call_scores=scores, **flags, **basis)


def as_dict(score: Score) -> dict[str, Any]:
    return asdict(score)
