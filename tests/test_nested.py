import json

from pyspark.sql import functions as F

from callweave.operators import nested
from callweave.operators.prepare import prepare

TOOLS = [
    {"name": " a ", "parameters": {"x": {"type": "int"}, "y": {"type": "list", "items": {"type": "object", "properties": {"z": {"type": "str"}, "w": {"type": "list", "items": {"items": {"properties": {"v": {}}}}}}}}}},
    {"type": "function", "function": {"name": "b", "parameters": {"type": "object", "properties": {"q": {"type": "object", "properties": {"r": {"type": "string"}}}}}}},
    {"name": "a", "parameters": None},
]
CALLS = [
    {"name": "a", "arguments": {"x": 1, "y": [{"z": None, "w": []}, {"z": "s"}], "e": {}}},
    {"name": "b ", "arguments": '{"q": {"r": true}}'},
    {"name": "c", "arguments": None},
    {"name": "d", "arguments": {}},
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "row_index long, tools string, answers string, pos int, kind string, path string")


def test_paths_and_links(spark):
    rows = [(1, json.dumps(TOOLS), json.dumps(CALLS), 9, "clash", "clash"), (2, "[", "[]", None, None, None), (3, None, None, None, None, None), (4, "{}", "5", None, None, None)]
    nodes = nested.shred(frame(spark, rows)).cache()
    got = {(r.child, r.pos, r.tool_pos, r.path) for r in nested.nested_found(nested.variant_tables(nodes.where("row_index = 1"))).collect()}
    assert got == {
        ("param", 0, 0, "x"), ("param", 0, 0, "y"), ("param", 0, 0, "y[].z"), ("param", 0, 0, "y[].w"), ("param", 0, 0, "y[].w[][].v"),
        ("param", 1, 1, "q"), ("param", 1, 1, "q.r"),
        ("arg", 0, 0, "x"), ("arg", 0, 0, "y[0].z"), ("arg", 0, 0, "y[0].w"), ("arg", 0, 0, "y[1].z"), ("arg", 0, 0, "e"), ("arg", 1, 1, "q.r"),
    }
    assert {r.variant for r in nodes.where("row_index in (2, 3)").collect()} == {"unreadable"}
    assert [r.kind for r in nodes.where("row_index = 4").collect()] == ["record"]
    ids = {(r.row_index, r.node_id) for r in nodes.collect()}
    assert all(r.parent_id is None or (r.row_index, r.parent_id) in ids for r in nodes.collect())
    tables = nested.variant_tables(nested.routed(nodes))
    assert {r.child for r in nested.nested_found(tables).collect()} == {"param", "arg"}
    links = {r.subtype: (r.n_rows, r.with_parent) for r in nested.parent_links(tables).collect()}
    assert all(n == k for name, (n, k) in links.items() if not name.startswith("record")) and links["record_unreadable"] == (2, 0)
    routes = {k: t for k, t in tables.items() if k != "param_scalar"}
    rows = lambda t: {(r.child, r.path) for r in nested.nested_found(t).collect()}
    assert rows(tables) - rows(routes) == {("param", "x"), ("param", "y[].z"), ("param", "q.r")}
    assert sum(t.count() for t in tables.values()) == nodes.count()
    assert tables["arg_number"].first()["value"] == 1.0 and tables["call_text"].count() == 1 and tables["tool_wrapped_schema"].count() == 1
    assert tables["param_array_of_objects"].count() == 2 and dict(tables["arg_boolean"].dtypes)["value"] == "boolean"


def test_empty_table_deep_and_long_values(spark):
    assert nested.shred(frame(spark, [])).count() == 0
    deep = "[" * 50_000 + "]" * 50_000
    text = json.dumps([{"name": "n", "arguments": {"t": "x" * 300_000, "s": "\ud800"}}])
    rows = [(1, deep, "[]", 0, "", ""), (2, "[]", text, 0, "", ""), (2, "[]", text, 0, "", "")]
    nodes = nested.shred(frame(spark, rows)).cache()
    assert nodes.where("row_index = 1").first()["variant"] == "unreadable"
    found = nested.nested_found(nested.variant_tables(nodes))
    assert found.where("path = 't'").count() == 2 and found.where(F.col("tool_pos") != -1).count() == 0


def test_preparation_takes_any_row(spark):
    rows = [(i, i, "q", t, a) for i, (t, a) in enumerate([(None, None), ("[]", "[]"), ('[{"name": 5}]', "[1]"), ("[NaN]", "[{}]"), ("[" * 9000, "x"), (json.dumps(TOOLS), json.dumps(CALLS))])]
    df = spark.createDataFrame([*rows, (9, None, None, None, None)], "row_index long, id long, query string, tools string, answers string")
    out = {r.row_index: r for r in prepare(df.withColumn("gate", F.lit("clash"))).collect()}
    assert len(out) == 7 and out[9].gate == "invalid_source_id" and out[0].gate == "invalid_record"
    assert all(r.gate is not None for r in out.values())
