"""Operators whose rules SQL cannot express, on stated cases: input rows and the rows that must come out.

Each case query runs the operator on its input; its SQL is the list of rows that was written down from the
rules, by hand. Whole tables go through the same operators in the other queries.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions import chat
from callweave.operators import evaluation, prepare, rendering, scoring, selection
from callweave.session import ensure_checkpoint_dir, table
from callweave.sources import files

CASES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def _literal(value: object) -> str:
    if value is None:
        return "NULL"
    if isinstance(value, (bool, int, float)):
        return str(value).lower()
    if isinstance(value, (list, tuple)):
        return "[" + ", ".join(map(_literal, value)) + "]"
    return "'" + str(value).replace("'", "''") + "'"


def stated(columns: str, rows: Iterable[tuple]) -> str:
    """SQL of stated rows; `columns` as 'name type, ...'."""
    names = [c.strip().split(" ") for c in columns.split(",")]
    cast = ", ".join(f'CAST("{n}" AS {t}) AS "{n}"' for n, t in names)
    return f"SELECT {cast} FROM (VALUES {', '.join('(' + ', '.join(map(_literal, r)) + ')' for r in rows)}) x({', '.join(chr(34) + n + chr(34) for n, _ in names)})"


def case(columns: str, rows: Iterable[tuple]) -> Callable:
    def add(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
        CASES[f.__name__], SQL[f.__name__] = f, stated(columns, rows)
        return f

    return add


# --- annotations ---------------------------------------------------------------------------------

_LIST, _SET = '{"items":{},"type":"array"}', '{"items":{},"type":"array","uniqueItems":true}'
_TYPES = [
    ("str", '{"type":"string"}', "string", False, None, None),
    ("TEXT", '{"type":"string"}', "string", False, None, None),
    ("INTEGER", '{"type":"integer"}', "integer", False, None, None),
    ("double", '{"type":"number"}', "number", False, None, None),
    ("bool, optional", '{"type":"boolean"}', "boolean", True, None, None),
    ("list", _LIST, "array", False, None, None),
    ("tuple", _LIST, "array", False, None, None),
    ("frozenset", _SET, "array", False, None, None),
    ("Mapping", '{"type":"object"}', "object", False, None, None),
    ("None", '{"type":"null"}', "null", False, None, None),
    ("Any", "{}", None, False, None, None),
    ("typing.List[int]", '{"items":{"type":"integer"},"type":"array"}', "array", False, None, None),
    ("Set[str]", '{"items":{"type":"string"},"type":"array","uniqueItems":true}', "array", False, None, None),
    ("Tuple[()]", _LIST, "array", False, None, None),
    ("Tuple[int, ...]", '{"items":{"type":"integer"},"type":"array"}', "array", False, None, None),
    ("Tuple[int, int]", '{"items":{"type":"integer"},"maxItems":2,"minItems":2,"type":"array"}', "array", False, None, None),
    ("Tuple[int, str]", '{"maxItems":2,"minItems":2,"prefixItems":[{"type":"integer"},{"type":"string"}],"type":"array"}', "array", False, None, None),
    ("Union[int, float]", '{"type":"number"}', "number", False, None, None),
    ("Union[str, int, str]", '{"anyOf":[{"type":"string"},{"type":"integer"}]}', None, False, None, None),
    ("int | str | None", '{"anyOf":[{"anyOf":[{"type":"integer"},{"type":"string"}]},{"type":"null"}]}', None, False, None, None),
    ("Optional[List[str]]", '{"anyOf":[{"items":{"type":"string"},"type":"array"},{"type":"null"}]}', None, False, None, None),
    ("Dict[str, float]", '{"additionalProperties":{"type":"number"},"type":"object"}', "object", False, None, None),
    ("Dict[str]", '{"additionalProperties":{},"type":"object"}', "object", False, None, None),
    ("str, optional, default 'Graz'", '{"type":"string"}', "string", True, '"Graz"', None),
    ("int, default 7", '{"type":"integer"}', "integer", False, "7", None),
    ("List[int], default [1, 2]", '{"items":{"type":"integer"},"type":"array"}', "array", False, "[1,2]", None),
    ("Callable[[str], int]", None, None, None, None, "Unsupported generic parameter type: 'Callable'."),
    ("Foo", None, None, None, None, "Unsupported parameter type name: 'Foo'."),
    ("3", None, None, None, None, "Unsupported type constant: 3."),
    ("list of ints", None, None, None, None, "Invalid parameter type expression: 'list of ints'."),
    ("List[int, str]", None, None, None, None, "List expects one type argument."),
    ("Optional[int, str]", None, None, None, None, "Optional expects exactly one type argument."),
    ("int, default oops(", None, None, None, None, "Invalid annotated default value in type 'int, default oops('."),
]


@case("type VARCHAR, schema VARCHAR, json_type VARCHAR, optional BOOLEAN, default_value VARCHAR, error VARCHAR", _TYPES)
def case_types(spark: SparkSession, folder: str) -> DataFrame:
    """Annotations, each twice, with the schema, the optional mark, the default or the error that each means."""
    rows = [(t,) for t, *_ in _TYPES] * 2
    return prepare.type_schemas(spark.createDataFrame(rows, "type string"))


# --- declarations, records, gates, issues ----------------------------------------------------------


def _tool(parameters: object, name: object = "book", **more: object) -> dict:
    return {"name": name, "description": "d", "parameters": parameters, **more}


def _raw(tools: object, answers: object) -> tuple[str, str]:
    return tuple(x if isinstance(x, str) else json.dumps(x) for x in (tools, answers))


_CALL = [{"name": "book", "arguments": {"day": "Mon"}}]
_DAY = {"day": {"type": "str", "required": True}}
#: declarations of one parameter `p` -> its schema or the error
_DECLARED = [
    ({"type": "int", "description": " n ", "minimum": 1, "default": 3}, '{"default":3,"description":"n","minimum":1,"type":"integer"}', None),
    ({"type": "str, default 'a'"}, '{"default":"a","type":"string"}', None),
    ({"type": "str, default 'a'", "default": "b", "description": "  "}, '{"default":"b","type":"string"}', None),
    ({"type": "list", "items": {"type": "int"}, "uniqueItems": 1}, '{"items":{"type":"integer"},"type":"array","uniqueItems":true}', None),
    ({"type": "List[int]", "items": "bool"}, '{"items":{"type":"boolean"},"type":"array"}', None),
    ({"type": "Tuple[int, str]"}, '{"items":{},"maxItems":2,"minItems":2,"prefixItems":[{"type":"integer"},{"type":"string"}],"type":"array"}', None),
    ({"type": "dict", "properties": {"a": {"type": "int", "required": True}, "b": {"type": "str"}}, "required": ["b"]}, '{"properties":{"a":{"type":"integer"},"b":{"type":"string"}},"required":["a","b"],"type":"object"}', None),
    ({"type": "object", "additionalProperties": {"type": "float"}}, '{"additionalProperties":{"type":"number"},"type":"object"}', None),
    ({"type": "object", "additionalProperties": False, "enum": [1]}, '{"additionalProperties":false,"enum":[1],"type":"object"}', None),
    ({"type": ["int", "None"]}, '{"anyOf":[{"type":"integer"},{"type":"null"}]}', None),
    ({"type": "dict", "properties": {"a": {}}}, None, "Parameter 'p.a' does not define a type."),
    ({"type": "list", "items": {"type": "dict", "additionalProperties": {"type": None}}}, None, "Parameter 'p[].*' does not define a type."),
    (5, None, "Parameter 'p' must be an object; received int."),
    ({"type": " "}, None, "Parameter type must be a non-empty string; received ' '."),
]


@case("row_index BIGINT, parameter VARCHAR, error VARCHAR", [(i, s, e) for i, (_, s, e) in enumerate(_DECLARED)])
def case_declarations(spark: SparkSession, folder: str) -> DataFrame:
    """Parameter declarations as JSON Schema, read out of the canonical record."""
    rows = [(i, 1, "q", *_raw([_tool({"p": d})], [{"name": "book"}])) for i, (d, _, _) in enumerate(_DECLARED)]
    p = prepare.prepare(spark.createDataFrame(rows, "row_index long, id long, query string, tools string, answers string"), depth=prepare.RECORD)
    return p.select("row_index", F.get_json_object("record", "$.tools[0].function.parameters.properties.p").alias("parameter"), "error")


_META = '"metadata":{"available_tool_count":%d,"expected_call_count":%d,"generator":"%s","source_dataset":"fc","source_id":%d,"split":"selection"},"schema_version":"1.0",'
_BOOK = '{"function":{"description":"d","name":"book","parameters":{"properties":{"day":{"type":"string"}},"required":["day"],"type":"object"}},"type":"function"}'


def _record(id_: int, tools: str, calls: str, n: tuple[int, int] = (1, 1)) -> str:
    generator = "deepseek" if id_ < 33_659 else "mixtral"
    return f'{{"id":"fc-{id_}","messages":[{{"content":"q w","role":"user"}},{{"content":"","role":"assistant","tool_calls":[{calls}]}}],' + _META % (*n, generator, id_) + f'"tools":[{tools}]}}'


def _called(i: int, arguments: str, name: str = "book") -> str:
    return f'{{"function":{{"arguments":{arguments},"name":"{name}"}},"id":"call_{i}","type":"function"}}'


_RECORDS = [
    (7, [_tool(_DAY)], _CALL, _record(7, _BOOK, _called(1, '{"day":"Mon"}')), None),
    (33_658, [{"type": "function", "function": _tool(_DAY)}], [{"name": " book ", "arguments": '{"day": "Mon"}'}], _record(33_658, _BOOK, _called(1, '{"day":"Mon"}')), None),
    (33_659, [_tool({"type": "object", "properties": {"day": {"type": "string"}}, "required": ["day"]}, " book")], _CALL, _record(33_659, _BOOK, _called(1, '{"day":"Mon"}')), None),
    (8, [{"name": "a"}, {"name": "b", "description": 5, "parameters": {}}], [{"name": "b"}, {"name": "a", "arguments": None}],
     _record(8, '{"function":{"description":"","name":"a","parameters":{"properties":{},"type":"object"}},"type":"function"},{"function":{"description":"5","name":"b","parameters":{"properties":{},"type":"object"}},"type":"function"}',
             _called(1, "{}", "b") + "," + _called(2, "{}", "a"), (2, 2)), None),
    (9, [_tool(_DAY)], [{"name": "walk"}], None, "Row 9: answer 1 references unavailable tool 'walk'."),
    (9, [_tool(_DAY)], _CALL + [{"name": "book", "arguments": "{"}], None, "Row 9: arguments for call 2 contain invalid JSON."),
    (9, [_tool(_DAY)], [{"name": "book", "arguments": "[1]"}], None, "Row 9: arguments for call 1 must be an object; received list."),
    (9, [_tool(_DAY)], [5], None, "Row 9: answer 1 must be an object."),
    (9, [_tool(_DAY)], [{"name": " "}], None, "Row 9: answer 1 has no valid tool name."),
    (9, [_tool(_DAY), _tool({}, "book ")], _CALL, None, "Row 9: duplicate tool names are present."),
    (9, [_tool([1])], _CALL, None, "Function parameters must be a dictionary."),
    (9, [_tool({"type": "object", "properties": {"a": 1}})], _CALL, None, "Parameter '<parameters>.a' must be an object; received int."),
    (9, [5], _CALL, None, "Row 9: tool must be an object."),
    (9, [_tool(_DAY, None)], _CALL, None, "Row 9: tool has no valid name."),
    (9, "[1", _CALL, None, "Row 9: tools contains invalid JSON. Preview: '[1'"),
    (9, "{}", _CALL, None, "Row 9: tools must be a non-empty list."),
    (9, [_tool(_DAY)], "[]", None, "Row 9: answers must be a non-empty list."),
]


def _rows(spark: SparkSession, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, "row_index long, id long, query string, tools string, answers string")


@case("row_index BIGINT, record VARCHAR, error VARCHAR", [(i, r, e) for i, (_, _, _, r, e) in enumerate(_RECORDS)])
def case_records(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows as canonical records, or why not."""
    rows = [(i, n, " q w ", *_raw(t, a)) for i, (n, t, a, _, _) in enumerate(_RECORDS)]
    return prepare.prepare(_rows(spark, rows), depth=prepare.RECORD).select("row_index", "record", "error")


_GATES = [
    (1, "q", [_tool(_DAY)], "x", "invalid_record"),
    (1, "q", [_tool(_DAY)], _CALL, "eligible"),
    (1, "q", [_tool(_DAY)], [{"name": "walk"}], "duplicate_id"),
    (1, "q", [_tool(_DAY)], _CALL, "duplicate_id"),
    (None, "q", [_tool(_DAY)], _CALL, "invalid_source_id"),
    (2, " ", [_tool(_DAY)], _CALL, "invalid_record"),
    (2, None, [_tool(_DAY)], _CALL, "invalid_record"),
    (3, "q", [_tool({"f": {"type": "Callable[[], int]"}})], _CALL, "normalization_unsupported_callable_parameters"),
    (3, "q", [_tool({"f": {"type": "a b"}})], _CALL, "normalization_invalid_parameter_type_expressions"),
    (3, "q", [_tool({"f": {"type": "Foo"}})], _CALL, "normalization_unsupported_parameter_types"),
    (3, "q", [_tool({"f": {"type": "5"}})], _CALL, "normalization_unsupported_parameter_types"),
    (3, "q", [_tool({"f": {"type": "x or y"}})], _CALL, "normalization_unsupported_parameter_types"),
    (3, "q", [_tool({"f": {"type": "List[int, int]"}})], _CALL, "normalization_other_errors"),
    (3, "q", [_tool(_DAY), _tool(_DAY)], _CALL, "normalization_duplicate_tool_names"),
    (3, "q", [_tool(_DAY)], [{"name": "walk"}], "normalization_unavailable_answer_tools"),
    (4, "q", [_tool(_DAY)], "[]", "invalid_record"),
]


def _gate_rows(spark: SparkSession) -> DataFrame:
    return _rows(spark, [(i, n, q, *_raw(t, a)) for i, (n, q, t, a, _) in enumerate(_GATES)])


@case("row_index BIGINT, gate VARCHAR", [(i, g) for i, (*_, g) in enumerate(_GATES)])
def case_gates(spark: SparkSession, folder: str) -> DataFrame:
    """The gate that stops each row; an id is taken by its first eligible row."""
    p = prepare.prepare(_gate_rows(spark), depth=prepare.RECORD).select("row_index", "id", "gate")
    return prepare.gated(p).select("row_index", F.coalesce("gate", F.lit("eligible")).alias("gate"))


@case("gate VARCHAR, n BIGINT", sorted({(g, sum(x[-1] == g for x in _GATES)) for *_, g in _GATES if g != "eligible"}))
def case_rejections(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.rejections(prepare.prepare(_gate_rows(spark), depth=prepare.RECORD))


def _length(day: str) -> int:
    """A quarter of the length of the canonical text of the tools and messages of a call with this day, rounded up."""
    return -(-len('{"messages":[{"content":"q","role":"user"},{"content":"","role":"assistant","tool_calls":[' + _called(1, '{"day":' + day + "}") + ']}],"tools":[' + _BOOK + "]}") // 4)


_KINDS = {"n": {"type": "int"}, "x": {"type": "float"}, "s": {"type": "str"}, "l": {"type": "List[int]"}, "u": {"type": "Optional[int]"}, "o": {"type": "Dict[str, int]"}, "d": {"type": "dict", "properties": {"k": {"type": "bool", "required": True}}}}
_ISSUES = [
    ([_tool(_DAY)], [{"name": "book"}], [("missing_required_arguments", "book.arguments.day is required.")]),
    ([_tool(_DAY)], [{"name": "book", "arguments": {"day": 5}}], [("incompatible_argument_type", "book.arguments.day expects string but received int.")]),
    ([_tool(_KINDS)], [{"name": "book", "arguments": {"n": 3, "x": 3, "s": "", "l": [1], "u": None, "o": {"a": 1}, "d": {"k": True}, "other": {}}}], []),
    ([_tool(_KINDS)], [{"name": "book", "arguments": {"n": 3.0, "x": True, "l": [1, None, "a"]}}], [
        ("incompatible_argument_type", "book.arguments.n expects integer but received float."), ("incompatible_argument_type", "book.arguments.x expects number but received bool."),
        ("incompatible_argument_type", "book.arguments.l[1] expects integer but received NoneType."), ("incompatible_argument_type", "book.arguments.l[2] expects integer but received str.")]),
    ([_tool(_KINDS)], [{"name": "book", "arguments": {"u": "x", "o": {"a": "b"}, "d": {}}}], [
        ("incompatible_argument_type", "book.arguments.u has incompatible type str."), ("incompatible_argument_type", "book.arguments.o.a expects integer but received str."),
        ("missing_required_arguments", "book.arguments.d.k is required.")]),
    ([_tool({"a": {"type": "list", "items": {"type": "Any"}}})], [{"name": "book"}], [("invalid_tool_schema", "tools[0].function.parameters.properties.a.items does not define a type."), ("unavailable_expected_tool", "tool_call 1 references unavailable tool 'book'.")]),
    ([_tool({"a": {"type": "Tuple[int, str]"}})], [{"name": "book"}], [("invalid_tool_schema", "tools[0].function.parameters.properties.a.items does not define a type."), ("unavailable_expected_tool", "tool_call 1 references unavailable tool 'book'.")]),
    ([_tool(_DAY)], [{"name": "walk"}], [("unavailable_expected_tool", "Row 1: answer 1 references unavailable tool 'walk'.")]),
    ([_tool(_DAY)], [{"name": "book", "arguments": "{"}], [("invalid_argument_object", "Row 1: arguments for call 1 contain invalid JSON.")]),
    ([_tool(_DAY)], [{"name": "book", "arguments": "7"}], [("invalid_argument_object", "Row 1: arguments for call 1 must be an object; received int.")]),
    ([_tool(_DAY)], "no", [("unparseable_expected_calls", "Row 1: answers contains invalid JSON. Preview: 'no'")]),
    ([_tool(_DAY)], [4], [("unparseable_expected_calls", "Row 1: answer 1 must be an object.")]),
    ([_tool({"answers": {}})], _CALL, [("unparseable_expected_calls", "Parameter 'answers' does not define a type.")]),
    ([_tool({"a": {}})], _CALL, [("invalid_tool_schema", "Parameter 'a' does not define a type.")]),
    ([_tool(_DAY)], [{"name": "book", "arguments": {"day": "x" * 1200}}], [("context_length_exceeded", f"Estimated rendered sequence length {_length(chr(34) + chr(120) * 1200 + chr(34))} tokens exceeds target context limit 300.")]),
]


@case("row_index BIGINT, pos INT, category VARCHAR, message VARCHAR", [(i, k, c, m) for i, (_, _, issues) in enumerate(_ISSUES) for k, (c, m) in enumerate(issues)])
def case_issues(spark: SparkSession, folder: str) -> DataFrame:
    """All issues of each row at a context limit of 300 tokens, in order."""
    p = prepare.prepare(_rows(spark, [(i, 1, "q", *_raw(t, a)) for i, (t, a, _) in enumerate(_ISSUES)]), limit=300)
    return p.select("row_index", F.posexplode("issues").alias("pos", "i")).select("row_index", "pos", "i.category", "i.message")


@case("category VARCHAR, n BIGINT", sorted({(c, sum(c in {x for x, _ in issues} for *_, issues in _ISSUES)) for *_, all_ in _ISSUES for c, _ in all_}))
def case_issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.issue_counts(prepare.prepare(_rows(spark, [(i, 1, "q", *_raw(t, a)) for i, (t, a, _) in enumerate(_ISSUES)]), limit=300))


# --- a selection evaluated and repaired ------------------------------------------------------------

# ids 0..5 of one pool in this order of their keys: 4, 3, 5, 1, 0, 2 (md5 of '42-' and the id); 0 and 1 are selected, 1 and 4 are faulty, 3 has the text of 0
_PLACES = [("train", 0, 0), ("test", 0, 1)]


def _selection(spark: SparkSession) -> tuple[DataFrame, DataFrame, DataFrame]:
    c = spark.createDataFrame([(i, i, "deepseek", "single_call", "f0" if i == 3 else f"f{i}") for i in range(6)], "row_index long, id long, generator string, call_bucket string, fingerprint string")
    raw = _rows(spark, [(i, i, "q", *_raw([_tool(_DAY)], [{"name": "book", "arguments": {"day": i if i in (1, 4) else "Mon"}}])) for i in range(6)])
    return spark.createDataFrame(_PLACES, "split string, pos int, id long"), c, raw


@case("split VARCHAR, pos INT, id BIGINT, estimated_tokens INT, categories VARCHAR[]", [("train", 0, 0, _length('"Mon"'), []), ("train", 1, 3, _length('"Mon"'), []), ("validation", 0, 1, _length("1"), ["incompatible_argument_type"]), ("test", 0, 3, _length('"Mon"'), ["duplicate_cross_split"])])
def case_evaluation(spark: SparkSession, folder: str) -> DataFrame:
    """A fault of a record, and one text in two splits: an issue of the later one; within a split it is none."""
    _, c, raw = _selection(spark)
    places = spark.createDataFrame([("train", 0, 0), ("train", 1, 3), ("validation", 0, 1), ("test", 0, 3)], "split string, pos int, id long")
    e = evaluation.evaluate(places, c, raw)
    return e.select("split", "pos", "id", "estimated_tokens", F.transform("issues", lambda i: i["category"]).alias("categories"))


@case("split VARCHAR, pos INT, id BIGINT, replaced BIGINT", [("train", 0, 0, None), ("test", 0, 5, 1)])
def case_repair(spark: SparkSession, folder: str) -> DataFrame:
    """The faulty record gives way to the next sound one of its pool whose text is not in use."""
    return evaluation.repair(*_selection(spark)).final


@case("row_index BIGINT", [(x,) for x in (0, 3, 7, 8, 21, 22, 23, 25)])
def case_inspection_sample(spark: SparkSession, folder: str) -> DataFrame:
    """Four row numbers on either side of 20, as the standard library's sample with seed 42 draws them."""
    return selection.inspection_sample(spark.range(30).toDF("row_index"), 20, each=4)


# --- model output ----------------------------------------------------------------------------------

_OUTPUTS = [
    ('{"name": " f ", "arguments": {"b": 1, "a": [true]}}', ["f"], ['{"a":[true],"b":1}'], True, [], False),
    ('Sure: [{"name": "f", "arguments": "{\\"a\\": 1}"}, {"function": {"name": "g", "arguments": {}}}] done', ["f", "g"], ['{"a":1}', "{}"], True, [], True),
    ('{"tool_calls": [{"type": "function", "function": {"name": "f", "arguments": {}}}]}', ["f"], ["{}"], True, [], False),
    ('{"calls": [{"name": "x", "arguments": {}}], "parallel_calls": []}', ["x"], ["{}"], True, [], False),
    ('{"name": "f"}', ["f"], [None], False, ["fragment[0].arguments is missing."], False),
    ('{"name": "f", "arguments": null}', ["f"], [None], False, ["fragment[0].arguments must be a JSON object."], False),
    ('{"name": "f", "arguments": "{"}', ["f"], [None], False, ["fragment[0].arguments contains invalid JSON."], False),
    ('{"arguments": {}} {"arguments": {}}', [None, None], ["{}", "{}"], False, ["fragment[0].name must be a non-empty string.", "fragment[1].name must be a non-empty string."], False),
    ("[1, {}]", [None], [None], False, ["fragment[0][0] must be a JSON object or list.", "fragment[0][1].name must be a non-empty string.", "fragment[0][1].arguments is missing."], False),
    ('{"function_calls": 5}', [], [], False, ["fragment[0].function_calls must be a JSON object or list."], False),
    ("{broken [ {\"name\": \"f\", \"arguments\": {}}", ["f"], ["{}"], True, [], True),
    ("I cannot { do that", [], [], False, ["No JSON object or array found in model output."], False),
    ("  ", [], [], False, ["Model output is empty."], False),
    (None, [], [], False, ["Model output is empty."], False),
]


@case("doc_id BIGINT, names VARCHAR[], arguments VARCHAR[], valid_structure BOOLEAN, errors VARCHAR[], had_extra_prose BOOLEAN", [(i, *r) for i, (_, *r) in enumerate(_OUTPUTS)])
def case_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Calls, arguments as canonical JSON, errors and prose of model outputs."""
    p = spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(_OUTPUTS)], "doc_id long, text string").select("doc_id", scoring.parse_calls("text").alias("p"))
    return p.select("doc_id", F.transform("p.calls", lambda c: c["name"]).alias("names"), F.transform("p.calls", lambda c: c["arguments"]).alias("arguments"), "p.valid_structure", "p.errors", "p.had_extra_prose")


_A, _B, _X = '{"name": "f", "arguments": {"a": 1}}', '{"name": "g", "arguments": {"a": 1}}', '{"name": "f", "arguments": {"a": 2}}'
#: predicted, expected -> name, argument names, values, complete, matched
_SCORES = [
    (f"[{_A}, {_B}]", f"[{_B}, {_A}]", True, True, True, True, 2),
    (f"[{_X}, {_A}]", f"[{_A}, {_A}]", True, True, False, False, 1),
    (f"[{_B}, {_X}]", f"[{_A}, {_X}]", False, True, True, False, 1),
    (f"[{_A}, {_A}]", f"[{_A}]", False, False, False, False, 1),
    (f"[{_A}]", f"[{_A}, {_B}]", False, False, False, False, 1),
    ('{"name": "h", "arguments": {"z": 0}}', _A, False, False, False, False, 0),
    ('{"name": "f", "arguments": {"a": 1.0}}', _A, True, True, True, True, 1),
    ('{"name": "f", "arguments": {"a": true}}', _A, True, True, True, True, 1),
]


@case("row BIGINT, correct_function_name BOOLEAN, correct_argument_names BOOLEAN, correct_argument_values BOOLEAN, complete_call_match BOOLEAN, matched INT", [(i, *r) for i, (_, _, *r) in enumerate(_SCORES)])
def case_assignment(spark: SparkSession, folder: str) -> DataFrame:
    """Unordered scores where the best assignment decides: complete before values before names before the function."""
    s = spark.createDataFrame([(i, p, e) for i, (p, e, *_) in enumerate(_SCORES)], "row long, p string, e string").select("row", scoring.score_calls("p", "e").alias("s"))
    return s.select("row", "s.correct_function_name", "s.correct_argument_names", "s.correct_argument_values", "s.complete_call_match", "s.matched")


# --- rendered text ---------------------------------------------------------------------------------

_MARKUP = [
    ("<tools>a</tools> x <|tools_start|> bcd <|tools_end|>", "bcd", ["<tools>", "</tools>", "<|tools_start|>", "<|tools_end|>"], False),
    ("<tools> ab </tools><tools>cd</tools>", "ab", ["<tools>", "</tools>"], False),
    ("<tool_call>1</tool_call><think> \n </think> <|thinking|>", None, ["<tool_call>", "</tool_call>"], False),
    ("<think>so</think>", None, [], True),
    ("<think>never closed <|think_start|>", None, [], True),
    ("<tools>open", None, ["<tools>"], False),
    ("", None, [], False),
]


@case("id BIGINT, tool_section VARCHAR, delimiters VARCHAR[], has_thinking BOOLEAN", [(i, *r) for i, (_, *r) in enumerate(_MARKUP)])
def case_markup(spark: SparkSession, folder: str) -> DataFrame:
    """Longest tool section, delimiters and thinking by native expressions."""
    return rendering.sections(spark.createDataFrame([(i, t) for i, (t, *_) in enumerate(_MARKUP)], "id long, text string"), "text").drop("text")


class _PythonStyle(chat.ChatMarkup):
    """Writes calls as Python dictionaries and thinks aloud."""

    def apply_chat_template(self, messages: list, tools: list | None = None, tokenize: bool = False, **kwargs: object) -> object:
        text = f"ask: {messages[0]['content']} <|think_start|> " + " ".join(str(c["function"]) for m in messages for c in m.get("tool_calls", []))
        return {"input_ids": [[i for i, _, _ in self.encode(text)]]} if tokenize else text


_TURNS = [("user", "When?", None), ("assistant", None, [("c", "function", ("book", '{"day": "Mon"}')), ("d", "function", ("book", '{"day": "Tue"}'))])]
_RECORD = "record_no long, messages array<struct<role: string, content: string, tool_calls: array<struct<id: string, type: string, function: struct<name: string, arguments: string>>>>>, tools array<struct<type: string, function: struct<name: string, description: string, parameters: string>>>"


def _chat(spark: SparkSession, turns: list) -> DataFrame:
    return spark.createDataFrame([(1, turns, [("function", ("book", "d", '{"type": "object"}'))])], _RECORD)


_CHECKED = ["tool_section_present", "tool_definitions_before_user_message", "function_names_unchanged", "arguments_as_json_objects", "tool_call_delimiters_present", "no_python_dict_syntax", "multiple_calls_serialized_correctly", "thinking_mode_disabled", "decoded_matches_rendered"]


@case("template VARCHAR, " + ", ".join(f"{c} BOOLEAN" for c in _CHECKED) + ", failed INT", [("chatml", *[True] * 9, 0), ("python", False, False, False, False, False, False, False, False, True, 8)])
def case_template(spark: SparkSession, folder: str) -> DataFrame:
    """The nine checks on a sound template and on one that breaks all that can break."""
    both = [rendering.template_checks(_chat(spark, _TURNS), t).select(F.lit(n).alias("template"), *_CHECKED, F.size("failures").alias("failed")) for n, t in (("chatml", chat.ChatMarkup), ("python", _PythonStyle))]
    return both[0].unionByName(both[1])


_TALK = [*_TURNS, ("tool", "booked", None), ("assistant", "<think>good</think> All set. ", None)]


@case("span_pos INT, region VARCHAR, in_loss BOOLEAN", [
    (0, "system_prompt", False), (1, "tool_definitions", False), (2, "system_prompt", False), (3, "user_request", False), (4, "assistant_scaffolding", False), (5, "assistant_tool_call", True), (6, "assistant_scaffolding", False),
    (7, "tool_execution_result", False), (8, "assistant_scaffolding", False), (9, "assistant_thinking", False), (10, "assistant_final_answer", False), (11, "assistant_scaffolding", False)])
def case_spans(spark: SparkSession, folder: str) -> DataFrame:
    """Regions of a chat with a tool result, thinking and a final answer; only calls are trained on."""
    return rendering.loss_spans(_chat(spark, _TALK)).select("span_pos", "region", "in_loss")


@case("region VARCHAR, trained BIGINT, tokens BIGINT", [("assistant_tool_call", 63, 63), ("padding", 0, 100)])
def case_padding(spark: SparkSession, folder: str) -> DataFrame:
    """Tokens of the calls, and of padding to 100 tokens beyond the text."""
    n = rendering.token_labels(_chat(spark, _TALK)).count()
    labels = rendering.token_labels(_chat(spark, _TALK), pad_to=n + 100)
    return labels.where("region in ('assistant_tool_call', 'padding')").groupBy("region").agg(F.count_if(F.expr("label <> -100")).alias("trained"), F.count("*").alias("tokens"))


# --- files: what is written comes back ---------------------------------------------------------------


def _place(spark: SparkSession, name: str) -> str:
    return f"{ensure_checkpoint_dir(spark)}/files/{name}-{spark.sparkContext.applicationId}"


def raw_lines_again(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows written as JSON lines in their order and read again."""
    rows = table(spark, folder, "raw_rows").select("row_index", "id", "query", "tools", "answers")
    files.write_json_lines(files.as_lines(rows), path := _place(spark, "lines"), "line", "row_index")
    return files.read_json_lines(spark, path, files.RAW)


def raw_array_again(spark: SparkSession, folder: str) -> DataFrame:
    """Raw rows written as one JSON array and read again with their places."""
    rows = table(spark, folder, "raw_rows").select("row_index", "id", "query", "tools", "answers")
    files.write_raw_array(rows, path := _place(spark, "array"))
    return files.read_raw_array(spark, path)


def records_again(spark: SparkSession, folder: str) -> DataFrame:
    """Split files of raw rows, normalized on the way in, in the order of split, source id and id."""
    made = [("train", 2, 7), ("validation", 0, 5), ("test", 0, 9), ("train", 0, 3), ("train", 1, 40_000)]
    base = _place(spark, "splits")
    for split in selection.SPLITS:
        rows = spark.createDataFrame([(i, n, "q w", *_raw([_tool(_DAY)], _CALL)) for s, i, n in made if s == split], "row_index long, id long, query string, tools string, answers string")
        files.write_json_lines(files.as_lines(rows), f"{base}/{split}.jsonl", "line", "row_index")
    source, records = prepare.load_records(spark, f"{base}/none", base)
    return records.select(F.lit(source).alias("source"), "split", "source_id", "id")


CASES |= {f.__name__: f for f in (raw_lines_again, raw_array_again, records_again)}
SQL |= {
    "raw_lines_again": "SELECT id, query, tools, answers FROM raw_rows",
    "raw_array_again": "SELECT row_number() OVER (ORDER BY row_index) - 1 AS row_index, id, query, tools, answers FROM raw_rows",
    "records_again": stated("source VARCHAR, split VARCHAR, source_id BIGINT, id VARCHAR", [("raw", s, n, f"fc-{n}") for s, n in (("train", 3), ("train", 7), ("train", 40_000), ("validation", 5), ("test", 9))]),
}
