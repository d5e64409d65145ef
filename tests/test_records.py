import json

import pytest

from callweave.functions.annotations import AnnotationError
from callweave.functions.checks import failure_issue, fits, raw_issues, record_issues, schema_issues, value_issues
from callweave.functions.records import canonical_record, complex_parameters, expected_calls, parameter_schema
from callweave.operators.prepare import bucket, profile, rejection


def row(**changes):
    tool = {"name": "book_table", "description": "d", "parameters": {"venue": {"type": "str", "required": True, "description": " c "}, "guests": {"type": "int, optional, default 4"}}}
    base = {"id": 1407, "query": " Is a table free? ", "tools": json.dumps([tool]), "answers": json.dumps([{"name": " book_table ", "arguments": {"venue": "Lido"}}])}
    return base | changes


def categories(**changes):
    return [c for c, _ in raw_issues(row(**changes), "train")[0]]


def tools(**parameter):
    return json.dumps([{"name": "book_table", "parameters": {"venue": {"type": "str", **parameter}}}])


def test_record():
    r = canonical_record(row(), "train")
    assert r["id"] == "fc-1407" and r["messages"][0]["content"] == "Is a table free?"
    assert r["tools"][0]["function"]["parameters"] == {"type": "object", "properties": {"venue": {"type": "string", "description": "c"}, "guests": {"type": "integer", "default": 4}}, "required": ["venue"]}
    assert expected_calls(r) == [{"name": "book_table", "arguments": {"venue": "Lido"}}]
    assert r["metadata"]["generator"] == "deepseek" and canonical_record(row(id=33_659), "x")["metadata"]["generator"] == "mixtral"


def test_shapes_of_tools_and_arguments():
    wrapped = json.dumps([{"type": "function", "function": {"name": "book_table", "description": None, "parameters": {"type": "object", "properties": {"venue": {"type": "string"}}, "required": ["venue"]}}}])
    r = canonical_record(row(tools=wrapped, answers=json.dumps([{"name": "book_table", "arguments": '{"venue": "Pergola"}'}, {"name": "book_table", "arguments": None}])), "train")
    assert r["tools"][0]["function"]["description"] == "" and r["tools"][0]["function"]["parameters"]["required"] == ["venue"]
    assert [c["id"] for c in r["messages"][1]["tool_calls"]] == ["call_1", "call_2"]
    assert [c["arguments"] for c in expected_calls(r)] == [{"venue": "Pergola"}, {}]


def test_nested_parameters():
    out = parameter_schema({"type": "dict", "properties": {"a": {"type": "list", "items": {"type": "int"}, "uniqueItems": 1}, "b": {"type": "str", "required": True}}, "required": ["a"], "additionalProperties": {"type": "int"}}, "p")
    assert out["properties"]["a"] == {"type": "array", "items": {"type": "integer"}, "uniqueItems": True}
    assert out["required"] == ["a", "b"] and out["additionalProperties"] == {"type": "integer"}
    with pytest.raises(AnnotationError, match=r"Parameter 'p\.c' does not define a type\."):
        parameter_schema({"type": "object", "properties": {"c": {}}}, "p")


@pytest.mark.parametrize(
    ("changes", "category"),
    [
        ({"answers": '[{"name": "other", "arguments": {}}]'}, "unavailable_expected_tool"),
        ({"answers": '[{"name": "book_table", "arguments": {}}]'}, "missing_required_arguments"),
        ({"tools": tools(type=None)}, "invalid_tool_schema"),
        ({"answers": "not-json"}, "unparseable_expected_calls"),
        ({"answers": "[]"}, "unparseable_expected_calls"),
        ({"answers": '[{"name": "book_table", "arguments": "[1]"}]'}, "invalid_argument_object"),
        ({"answers": '[{"name": "book_table", "arguments": "{"}]'}, "invalid_argument_object"),
        ({"query": None}, "invalid_tool_schema"),
    ],
)
def test_issue_categories(changes, category):
    assert categories(**changes) == [category]


def test_incompatible_arguments_and_length():
    assert categories(answers='[{"name": "book_table", "arguments": {"venue": 5.5, "guests": ["few"]}}]') == ["incompatible_argument_type"] * 2
    issues, tokens = raw_issues(row(query="x" * 1300), "train", limit=90)
    assert "context_length_exceeded" in [c for c, _ in issues] and tokens > 90


def test_value_checks():
    schema = {"type": "array", "prefixItems": [{"type": "string"}], "items": {"type": "integer"}}
    assert not list(value_issues(["a", 1], schema, "p"))
    assert list(value_issues([1, 2.5, True], schema, "p")) == [
        ("incompatible_argument_type", "p[0] expects string but received int."),
        ("incompatible_argument_type", "p[1] expects integer but received float."),
        ("incompatible_argument_type", "p[2] expects integer but received bool."),
    ]
    both = {"anyOf": [{"type": "string"}, {"type": "null"}]}
    assert not list(value_issues(None, both, "p")) and list(value_issues(1, both, "p"))
    extra = {"type": "object", "properties": {"a": {"type": "string"}}, "additionalProperties": {"type": "integer"}}
    assert [m for _, m in value_issues({"a": 1, "b": "x"}, extra, "p")] == ["p.a expects string but received int.", "p.b expects integer but received str."]
    assert fits("number", 1) and not fits("number", True) and fits("whatever", object())


def test_schema_checks():
    bad = {"type": "object", "properties": {"a": {"anyOf": []}, "b": {"type": "int"}, "c": {"type": "array", "items": {}, "prefixItems": 1}}, "required": [1], "additionalProperties": 3}
    assert [m for _, m in schema_issues(bad, "p")] == [
        "p.properties.a.anyOf must be a non-empty list.",
        "p.properties.b has unsupported type 'int'.",
        "p.properties.c.items does not define a type.",
        "p.properties.c.prefixItems must be a list.",
        "p.required must be a list of strings.",
        "p.additionalProperties must be a schema or boolean.",
    ]
    assert record_issues({"tools": None}) == ([("invalid_tool_schema", "Normalized tools must be a list.")], None)
    assert failure_issue("Parameter 'answers' does not define a type.")[0] == "unparseable_expected_calls"


def test_rejections_and_profile():
    twice = json.dumps([{"name": "a"}, {"name": "a "}])
    with pytest.raises(AnnotationError) as e:
        canonical_record(row(tools=twice, answers='[{"name": "a"}]'), "x")
    assert rejection(str(e.value)) == "normalization_duplicate_tool_names"
    for text, name in (("Callable[[str], int]", "unsupported_callable_parameters"), ("a b", "invalid_parameter_type_expressions"), ("Foo", "unsupported_parameter_types"), ("List[int, str]", "other_errors")):
        with pytest.raises(AnnotationError) as e:
            canonical_record(row(tools=tools(type=text)), "x")
        assert rejection(str(e.value)) == f"normalization_{name}"
    assert [bucket(n) for n in range(5)] == ["zero_calls", "single_call", "two_calls", "three_or_more_calls", "three_or_more_calls"]
    p = profile(1, " A  b ", [{"name": "t", "parameters": {"x": {"type": "List[int]"}, "y": {}}}], [{"name": "t"}, {"name": "u", "arguments": {"b": 1, "a": 2}}])
    assert p["unknown_answer_tools"] == ["u"] and p["parameter_types"] == ["List[int]"] and p["has_complex_parameters"] and p["type_occurrences"] == ["List[int]", "<missing>"]
    assert p["argument_keys"] == [[], ["a", "b"]]
    assert p["fingerprint"] == profile(2, "a b", [{"parameters": {"x": {"type": "List[int]"}, "y": {}}, "name": "t"}], [{}])["fingerprint"]


def test_complex_parameters_are_found_by_structure():
    record = lambda p: {"tools": [{"function": {"parameters": {"type": "object", "properties": p}}}]}
    assert not complex_parameters(record({"a": {"type": "string"}}))
    assert complex_parameters(record({"a": {"type": "string", "x": [{"anyOf": []}]}}))
    assert complex_parameters(record({"a": {"type": "array"}}))
