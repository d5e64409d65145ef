import pytest

from callweave.functions.annotations import AnnotationError, annotated_default, compile_type, type_label

STR, INT, NUM = {"type": "string"}, {"type": "integer"}, {"type": "number"}


@pytest.mark.parametrize(
    ("text", "schema"),
    [
        ("str", STR),
        ("builtins.Text", STR),
        ("Double", NUM),
        ("None", {"type": "null"}),
        ("any", {}),
        ("set", {"type": "array", "items": {}, "uniqueItems": True}),
        ("List[int]", {"type": "array", "items": INT}),
        ("typing.Sequence[str]", {"type": "array", "items": STR}),
        ("FrozenSet[str]", {"type": "array", "items": STR, "uniqueItems": True}),
        ("Tuple[()]", {"type": "array", "items": {}}),
        ("Tuple[int, ...]", {"type": "array", "items": INT}),
        ("Tuple[int, int]", {"type": "array", "items": INT, "minItems": 2, "maxItems": 2}),
        ("Tuple[int, str]", {"type": "array", "prefixItems": [INT, STR], "minItems": 2, "maxItems": 2}),
        ("Union[int, float]", NUM),
        ("Union[str, str]", STR),
        ("int | str | None", {"anyOf": [{"anyOf": [INT, STR]}, {"type": "null"}]}),
        ("Optional[str]", {"anyOf": [STR, {"type": "null"}]}),
        ("Dict[str, int]", {"type": "object", "additionalProperties": INT}),
        ("Dict[str]", {"type": "object", "additionalProperties": {}}),
        ("str, optional, default 'Graz'", STR),
        (["int", "str, optional"], {"anyOf": [INT, STR]}),
    ],
)
def test_schemas(text, schema):
    assert compile_type(text)[0] == schema


@pytest.mark.parametrize(
    ("text", "message"),
    [
        ("Callable", "Unsupported parameter type name: 'Callable'."),
        ("Callable[[str], int]", "Unsupported generic parameter type: 'Callable'."),
        ("List[int, str]", "List expects one type argument."),
        ("Optional[int, str]", "Optional expects exactly one type argument."),
        ("List[", "Invalid parameter type expression: 'List['."),
        ("7", "Unsupported type constant: 7."),
        ("a and b", "Unsupported type expression"),
        ("", "Parameter type must be a non-empty string; received ''."),
        (None, "Parameter type must be a non-empty string; received None."),
    ],
)
def test_errors(text, message):
    with pytest.raises(AnnotationError) as e:
        compile_type(text)
    assert message in str(e.value)


def test_marks_defaults_and_labels():
    assert compile_type("int, optional")[1] and not compile_type("int")[1]
    assert annotated_default("str, optional, default 'Graz'") == (True, "Graz")
    assert annotated_default("str") == (False, None)
    assert annotated_default(["str"]) == (False, None)
    with pytest.raises(AnnotationError):
        annotated_default("str, default oops(")
    assert type_label("List[int]") == "array"
    assert "anyOf" in type_label("Union[int, str]")
    compile_type("list")[0]["items"]["x"] = 1  # results are independent of each other
    assert compile_type("list")[0] == {"type": "array", "items": {}}
