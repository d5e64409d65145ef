"""Deeply nested semi-structured records as related flat tables (problem 1).

Every JSON node gets a state from a bottom-up tree automaton: the state depends on the node's label
and the states of the children that the rules name (DECLARATION, PARAMETERS, BODY, TOOL, CALL). The
states of tools, parameters, calls and arguments are the structural variants; each variant goes to a subtype table with the columns that
this shape has, and every row keeps the supertype keys (row_index, node_id, parent_id, pos, path).

Edge cases: records whose tools or answers are null or not standard JSON give one `record` row with
variant 'unreadable' and no children; valid JSON that is no array gives no children; null, missing
or empty arguments give no rows; a decoder-breaking depth counts as unreadable. Input columns other
than row_index, tools and answers are ignored, whatever their names. Repeated rows stay repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.jsonx import BAD, canonical, try_loads
from callweave.session import shared_table, spread

NODE_SCHEMA = (
    "row_index long, kind string, variant string, node_id string, parent_id string, pos int, tool_pos int, "
    "depth int, name string, path string, type string, description string, required boolean, value string"
)
_FIELDS = [c.split()[0] for c in NODE_SCHEMA.split(", ")]
_ARROW = {"long": pa.int64(), "string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
_ARROW_SCHEMA = pa.schema([(c.split()[0], _ARROW[c.split()[1]]) for c in NODE_SCHEMA.split(", ")])

#: Variant of a node -> the subtype table that takes it.
SUBTYPES = {
    "tool": ("flat", "schema", "bare", "wrapped_flat", "wrapped_schema", "wrapped_bare", "other"),
    "param": ("scalar", "object", "array", "array_of_objects", "untyped"),
    "call": ("object", "text", "empty", "other"),
    "arg": ("string", "number", "boolean", "null", "empty_object", "empty_array"),
    "record": ("readable", "unreadable"),
}


# The automaton: a node's state from the states of the children that a rule names; the first rule that
# holds decides. A child's state may be one of several; "*" is any child, "" an absent one.
Rules = tuple[tuple[dict[str, tuple[str, ...]], str], ...]
_MAP = ("map", "empty_object")
DECLARATION: Rules = (
    ({"properties": _MAP}, "object"),
    ({"items": ("object", "array_of_objects")}, "array_of_objects"),
    ({"items": ("*",)}, "array"),
    ({"type": ("string",)}, "scalar"),
    ({}, "untyped"),
)
PARAMETERS: Rules = (({"type": ("string",)}, "schema"), ({}, "flat"))
BODY: Rules = (({"parameters": ("schema",)}, "schema"), ({"parameters": ("flat",)}, "flat"), ({}, "bare"))
TOOL: Rules = (
    ({"function": ("schema",)}, "wrapped_schema"),
    ({"function": ("flat",)}, "wrapped_flat"),
    ({"function": ("bare",)}, "wrapped_bare"),
    ({"self": ("schema",)}, "schema"),
    ({"self": ("flat",)}, "flat"),
    ({}, "bare"),
)
CALL: Rules = (
    ({"arguments": ("json_text",)}, "text"),
    ({"arguments": ("", "null", "empty_object")}, "empty"),
    ({"arguments": ("map",)}, "object"),
    ({}, "other"),
)


def leaf_state(value: Any) -> str:
    """States of nodes by their label alone."""
    match value:
        case None:
            return "null"
        case bool():
            return "boolean"
        case int() | float():
            return "number"
        case str():
            return "string"
        case dict():
            return "map" if value else "empty_object"
    return "list" if value else "empty_array"


def transition(rules: Rules, children: dict[str, str]) -> str:
    """The state that the rules give to a node with these child states."""
    for wanted, state in rules:
        if all(("*" in states and k in children) or children.get(k, "") in states for k, states in wanted.items()):
            return state
    raise AssertionError("every rule list ends with a rule that always holds")


def schema_state(decl: Any) -> tuple[str, list[tuple[str, dict]]]:
    """State of a parameter declaration, and the maps of parameters below it with the path step that leads there.

    Runs up the chain of `items` from its end, so each declaration is looked at once.
    """
    below, chain, step = [], [], ""
    while isinstance(decl, dict):
        chain.append({k: leaf_state(decl[k]) for k in ("properties", "items", "type") if k in decl})
        if isinstance(decl.get("properties"), dict) and decl["properties"]:
            below.append((step, decl["properties"]))
        decl, step = decl.get("items"), step + "[]"
    state = ""
    for children in reversed(chain):
        if state:
            children["items"] = state
        state = transition(DECLARATION, children)
    return state or "untyped", below


def params_state(parameters: Any) -> tuple[str, dict]:
    """State of a tool's `parameters` and its map of top-level parameters."""
    if not isinstance(parameters, dict) or not parameters:
        return leaf_state(parameters), {}
    state = transition(PARAMETERS, {"type": leaf_state(parameters["type"])} if "type" in parameters else {})
    params = parameters if state == "flat" else parameters.get("properties")
    return state, params if isinstance(params, dict) else {}


def tool_state(tool: Any) -> tuple[str, dict, dict]:
    """State of a tool: variant, the object that names it, its parameters."""
    if not isinstance(tool, dict):
        return "other", {}, {}
    place = "function" if isinstance(tool.get("function"), dict) else "self"
    body = tool["function"] if place == "function" else tool
    state, params = params_state(body.get("parameters"))
    return transition(TOOL, {place: transition(BODY, {"parameters": state})}), body, params


def call_state(call: Any) -> tuple[str, Any]:
    """State of a call from that of its arguments, and the decoded arguments."""
    if not isinstance(call, dict):
        return "other", None
    body = call["function"] if isinstance(call.get("function"), dict) else call
    args = body.get("arguments")
    children = {"arguments": leaf_state(args)} if "arguments" in body else {}
    if isinstance(args, str):
        value = try_loads(args)
        args = None if value is BAD else value
        if value is not BAD:
            children["arguments"] = "json_text"
    return transition(CALL, children), args


def _name(body: dict) -> str | None:
    return body["name"].strip() if isinstance(body.get("name"), str) else None


def _text(value: Any) -> str | None:
    return None if value is None else value if isinstance(value, str) else canonical(value)


def shred_record(row_index: int, tools: str | None, answers: str | None, emit: Any) -> None:
    """Emit the nodes of one record, parents before children."""
    tool_list, call_list = try_loads(tools), try_loads(answers)
    root = "r"
    readable = tool_list is not BAD and call_list is not BAD
    emit(row_index, "record", "readable" if readable else "unreadable", root, None, None, None, 0, None, None, None, None, None, None)
    if not readable:
        return
    first: dict[str, int] = {}
    for pos, tool in enumerate(tool_list if isinstance(tool_list, list) else []):
        variant, body, params = tool_state(tool)
        name, node = _name(body), f"t{pos}"
        if name is not None:
            first.setdefault(name, pos)
        emit(row_index, "tool", variant, node, root, pos, pos, 1, name, None, _text(tool.get("type")) if isinstance(tool, dict) else None, _text(body.get("description")), None, None)
        todo = [(params, "", node, 2)]
        while todo:
            table, prefix, parent, depth = todo.pop()
            for key, decl in table.items():
                state, below = schema_state(decl)
                path = f"{prefix}{key}"
                child = f"{node}.{path}"
                decl = decl if isinstance(decl, dict) else {"type": decl}
                emit(row_index, "param", state, child, parent, pos, pos, depth, key, path, _text(decl.get("type")), _text(decl.get("description")), decl.get("required") is True, _text(decl["default"]) if "default" in decl else None)
                todo += [(props, f"{path}{step}.", child, depth + 1) for step, props in below]
    for pos, call in enumerate(call_list if isinstance(call_list, list) else []):
        variant, args = call_state(call)
        body = call if isinstance(call, dict) else {}
        name = _name(body["function"] if isinstance(body.get("function"), dict) else body)
        tool_pos, node = first.get(name, -1), f"c{pos}"
        emit(row_index, "call", variant, node, root, pos, tool_pos, 1, name, None, None, None, None, None)
        if args is None or args == {} or args == []:
            continue
        todo = [(args, "", None, 1)]
        while todo:
            value, path, key, depth = todo.pop()
            if isinstance(value, dict) and value:
                dot = "." if path else ""
                todo += [(v, f"{path}{dot}{k}", k, depth + 1) for k, v in value.items()]
            elif isinstance(value, list) and value:
                todo += [(v, f"{path}[{i}]", key, depth + 1) for i, v in enumerate(value)]
            else:
                emit(row_index, "arg", leaf_state(value), f"{node}.{path}", node, pos, tool_pos, depth, key, path, None, None, None, value if isinstance(value, str) else canonical(value))


def _shred(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        emit = lambda *x: rows.append(x)
        for row in zip(*(batch.column(i).to_pylist() for i in range(3))):
            shred_record(*row, emit)
            if len(rows) > 20_000:
                yield _batch(rows)
                rows.clear()
        if rows:
            yield _batch(rows)


def _clean(x: Any) -> Any:
    return x.encode("utf-8", "replace").decode() if isinstance(x, str) and not x.isascii() else x


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows))
    arrays = []
    for values, field in zip(columns, _ARROW_SCHEMA):
        try:
            arrays.append(pa.array(values, field.type))
        except UnicodeEncodeError:  # lone surrogates from escapes
            arrays.append(pa.array([_clean(v) for v in values], field.type))
    return pa.RecordBatch.from_arrays(arrays, schema=_ARROW_SCHEMA)


def shred(df: DataFrame) -> DataFrame:
    """All nodes of the records (row_index, tools, answers) as one supertype table."""
    rows = spread(df.select(F.col("row_index").cast("long"), F.col("tools").cast("string"), F.col("answers").cast("string")))
    return rows.mapInArrow(_shred, NODE_SCHEMA)


_KEYS = ["row_index", "node_id", "parent_id", "pos", "tool_pos", "name"]
_OWN = {
    "tool": ["type", "description"],
    "param": ["depth", "path", "type", "description", "required", "value"],
    "call": [],
    "arg": ["depth", "path", "value"],
    "record": [],
}


def routed(nodes: DataFrame) -> DataFrame:
    """The supertype table written once to the shared folder, each variant to its own part, for `variant_tables`.

    A task writes one file for each variant that it meets, 24 at most.
    """
    return shared_table(nodes, "kind", "variant")


def variant_tables(nodes: DataFrame) -> dict[str, DataFrame]:
    """The supertype table routed into one typed table per structural variant, e.g. `tool_wrapped_schema`.

    Values of numeric and boolean arguments are typed; all tables keep the common keys and parent link.
    `nodes` should come from `routed`, so that each subtype reads its own part only.
    """
    out = {}
    for kind, variants in SUBTYPES.items():
        for variant in variants:
            part = nodes.where((F.col("kind") == kind) & (F.col("variant") == variant)).select(*_KEYS, *_OWN[kind])
            if kind == "param":
                part = part.withColumnRenamed("value", "default_json")
            if kind == "arg" and variant in ("number", "boolean"):
                part = part.withColumn("value", F.expr(f"try_cast(value AS {'double' if variant == 'number' else 'boolean'})"))
            if kind == "arg" and (variant == "null" or variant.startswith("empty")):
                part = part.drop("value")
            out[f"{kind}_{variant}"] = part
    return out


def nested_found(tables: dict[str, DataFrame]) -> DataFrame:
    """Parameters at any depth and argument leaves of the readable records: the union of their subtype tables."""
    parts = [t.select("row_index", F.lit(kind).alias("child"), "pos", "tool_pos", "path") for kind in ("param", "arg") for name, t in tables.items() if name.startswith(f"{kind}_")]
    return reduce(DataFrame.unionByName, parts)


def parent_links(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows of each subtype table, and how many of them have their parent in one of the tables.

    Links are counted per parent before the join, so a parent with very many children is one row of it.
    """
    link = lambda c: F.xxhash64("row_index", c)
    parts = [t.select(F.lit(name).alias("subtype"), F.when(F.col("parent_id").isNotNull(), link("parent_id")).alias("parent")) for name, t in tables.items()]
    rows = reduce(DataFrame.unionByName, parts).groupBy("subtype", "parent").agg(F.count("*").alias("n"))
    ids = reduce(DataFrame.unionByName, (t.select(link("node_id").alias("parent")) for name, t in tables.items() if not name.startswith("arg_"))).distinct()
    out = rows.join(ids.withColumn("there", F.lit(1)), "parent", "left").groupBy("subtype")
    return out.agg(F.sum("n").alias("n_rows"), F.sum(F.when(F.col("there") == 1, F.col("n")).otherwise(0)).alias("with_parent"))


def variant_counts(nodes: DataFrame) -> DataFrame:
    """Rows and records per kind and structural variant, with the deepest nesting."""
    return nodes.groupBy("kind", "variant").agg(F.count("*").alias("nodes"), F.countDistinct("row_index").alias("records"), F.max("depth").alias("max_depth"))
