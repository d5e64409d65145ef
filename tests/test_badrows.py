import random

import pytest

from callweave.jsonx import is_json_deep
from callweave.operators.badrows import bad_rows, diagnose, good_rows, parse_block, parse_lines

GOOD = '1,q,"[{""a"": 1}]","[{}]"'


@pytest.mark.parametrize(
    ("line", "reason"),
    [
        (GOOD, None),
        (' 007 ,"a\nb, ""c""",[{}],[{}]', None),
        ("9223372036854775807,q,[{}],[{}]", None),
        ("9223372036854775808,q,[{}],[{}]", "id"),
        ('"1",q,"[{}]","[{}]', "quoting"),
        ('1,"q"x,[{}],[{}]', "quoting"),
        ('1,q "odd",[{}],[{}]', "quoting"),
        ("1,q,[{}]", "column_count"),
        ("1,q,[{}],[{}],", "column_count"),
        ("", "column_count"),
        (None, "column_count"),
        ("-1,q,[{}],[{}]", "id"),
        ("٣,q,[{}],[{}]", "id"),
        (",q,[{}],[{}]", "id"),
        ("1,q,[],[{}]", "tools"),
        ('1,q,"[{""a"": NaN}]",[{}]', "tools"),
        ("1,q,[{}] x,[{}]", "tools"),
        ("1,q,[{}],", "answers"),
        ('1,q,[{}],"[{}, 1]"', "answers"),
        ("1,q,[{}],{}", "answers"),
        ('1,q,[{}],"[{""a"": ' + "[" * 6000 + "]" * 6000 + '}]"', None),
        ('1,q,[{}],"[{""a"": ' + "[" * 6000 + "]" * 5999 + '}]"', "answers"),
        ('1,q,[{}],"[{""n"": ' + "1" * 6000 + '}]"', None),
    ],
)
def test_reasons(line, reason):
    assert diagnose(line)[0] == reason
    assert parse_block([GOOD, line, GOOD])[1][0] == reason


def test_blocks_equal_single_diagnosis():
    rng = random.Random(5)
    pieces = ['"', '""', ",", "1", "[{}]", "[", "]", "\n", "\r", "x", " ", '"[{}]"', '"[{""a"": 1}]"', "é"]
    lines = [GOOD if rng.random() < 0.7 else "".join(rng.choice(pieces) for _ in range(rng.randint(0, 9))) for _ in range(4000)]
    lines += ["1,q,[{}", "2,q,{}],[{}]", "3,q,[[{}],[{}]", "4,q,[{}]],[{}]"]  # together they would look whole
    assert parse_block(lines) == [diagnose(x) for x in lines]


def test_deep_check():
    assert is_json_deep('[{"a": [1, -2.5e3, "x\\u00e9", true, null, {}]}, {}]') == (True, True)
    assert is_json_deep("[]") == (True, False) and is_json_deep("[[{}]]") == (True, False) and is_json_deep('[{}, "a"]') == (True, False)
    for bad in ("[01]", "[1,]", '{"a"}', "[{}] x", '["\t"]', "", "[NaN]", "[1 2]"):
        assert is_json_deep(bad) == (False, False)


def test_table(spark):
    df = spark.createDataFrame([(1, GOOD, "clash"), (2, "x", "clash"), (3, GOOD, "clash"), (4, None, None)], "line_id long, line string, reason string")
    parsed = parse_lines(df)
    assert {(r.line_id, r.reason) for r in bad_rows(parsed).collect()} == {(2, "column_count"), (4, "column_count")}
    assert [(r.line_id, r.id, r.tools) for r in good_rows(parsed).orderBy("line_id").collect()] == [(1, 1, '[{"a": 1}]'), (3, 1, '[{"a": 1}]')]
    assert parse_lines(df.limit(0)).count() == 0
