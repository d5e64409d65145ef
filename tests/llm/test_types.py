import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from callweave.llm import canonical_map as m
from callweave.llm.oracles import CATALOG

REFS = m.reference_rows(list(CATALOG))


def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        old, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            old, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, old + (x != y))
    return row[-1]


def brute(value, refs, k=1):
    close = []
    for ref, target in refs:
        d = edits(value, ref)
        swap = d == 2 and len(value) == len(ref) and sorted(value) == sorted(ref)
        if d == 0 or (len(value) > k and (d <= k or swap)):
            close.append((1 if swap else d, target))
    return min(close)[1] if close else 0


@pytest.mark.parametrize("k", [1, 2, 3])
@settings(max_examples=4, deadline=None)
@given(st.lists(st.text("abi[]", max_size=9), min_size=1, max_size=40), st.lists(st.text("abi[]", min_size=1, max_size=8), min_size=1, max_size=25, unique=True))
def test_join_equals_brute_force(spark, k, values, refs):
    refs = [(r, i + 1) for i, r in enumerate(refs)]
    out = m.map_values(spark.createDataFrame([(v,) for v in values], "value string"), spark.createDataFrame(refs, "ref string, target int"), k).collect()
    assert {r.value: r.target for r in out} == {v: brute(v, refs, k) for v in values} and len(out) == len(set(values))


@pytest.mark.parametrize("k", [1, 2])
def test_typing_errors_are_found_without_aliases(spark, k):
    """Recall on k random edits of the catalog's own names alone; no alias takes part."""
    rng = random.Random(k)
    refs = [(c.lower().replace(" ", ""), i + 1) for i, c in enumerate(CATALOG) if len(c) > 5]
    cases = {}
    for _ in range(400):
        ref, target = rng.choice(refs)
        for _ in range(k):
            i, c = rng.randrange(len(ref)), rng.choice("abcdefghij")
            ref = rng.choice((ref[:i] + c + ref[i:], ref[:i] + ref[i + 1 :], ref[:i] + c + ref[i + 1 :]))
        cases[ref] = target
    out = {r.value: r for r in m.map_values(spark.createDataFrame([(v,) for v in cases], "value string"), spark.createDataFrame(refs, "ref string, target int"), k).collect()}
    assert all(out[v].target > 0 and out[v].edits <= k for v in cases)
    assert sum(out[v].target == t for v, t in cases.items()) >= 0.95 * len(cases)


def test_alias_tables_take_the_place_of_the_catalog(spark, monkeypatch):
    monkeypatch.setattr("callweave.session.HOT_ROWS", 5)
    p = spark.createDataFrame([(i, "Grossstadt") for i in range(40)] + [(100, "vilage"), (101, "Berg"), (102, "town"), (103, None)], "param_id long, type string")
    catalog = spark.createDataFrame([(1, "city"), (2, "village"), (3, "town")], "type_id int, canonical string")
    refs = spark.createDataFrame([("grossstadt", 1), ("city", 1), ("village", 2), ("town", 3)], "ref string, target int")
    got = {r.param_id: r.type_id for r in m.found(spark, p, catalog, refs).collect()}
    assert got == {**{i: 1 for i in range(40)}, 100: 2, 101: 0}
    assert [tuple(r) for r in m.unmatched(spark, p, catalog, refs).collect()] == [("Berg", 1)]
    assert not [t.name for t in spark.catalog.listTables() if t.name.startswith("cm_")]


@pytest.mark.parametrize(
    ("raw", "canonical"),
    [
        ("`STR`, Optional", "str"), ("chaîne;", "str"), ("varchar(255), optional, default 10", "str"), ("Ganzzahl", "int"), ("numpy.int64", "int"), ("itn32", "int"),
        ("<flaot>", "float"), ("yes/no", "bool"), ("Liste", "list"), ("object", "dict"), ("typing.Any", "Any"), ("date (YYYY-MM-DD)", "date"), ("TIMESTAMP", "datetime"),
        ("Lisst[int]", "List[int]"), ("a list of whole numbers", "List[int]"), ("double[][]", "List[List[float]]"), ("ArrayList<HashMap<String, any>>", "List[Dict[str, Any]]"),
        ("{str: anything}[]", "List[Dict[str, Any]]"), ("(int, integer)", "Tuple[int, int]"), ("pair of decimals", "Tuple[float, float]"), ("unique ints", "Set[int]"),
        ("mapping from text to double", "Dict[str, float]"), ("Either<Integer, Double>", "Union[int, float]"), ("Optional[List[str]]", "List[str]"), ("Dict [str , Any], default 49", "Dict[str, Any]"),
        ("str, default 'a, b'", "str"), ("x", None), ("", None), ("  ", None), ("default", None), ("city name", None), ("FooConfig", None), ("self", None), ("percentage", None), ("???", None), ("a" * 100_000, None),
    ],
)
def test_values(spark, raw, canonical):
    test_values.cases = getattr(test_values, "cases", {}) | {raw: canonical}


def test_all_values_at_once(spark):
    cases = test_values.cases
    p = spark.createDataFrame([(i, t, "x") for i, t in enumerate([*cases, None, "str", "str"])], "param_id long, type string, value string")
    catalog = spark.createDataFrame([(i + 1, c) for i, c in enumerate(CATALOG)], "type_id int, canonical string")
    got = {r.param_id: r.type_id for r in m.found(spark, p, catalog).collect()}
    assert got == {i: CATALOG.index(c) + 1 if c else 0 for i, c in enumerate(cases.values())}
    assert sum(r.n_rows for r in m.unmatched(spark, p, catalog).collect()) == sum(c is None for c in cases.values())
    assert m.found(spark, p.limit(0), catalog).count() == 0


def test_reference_list_is_consistent():
    assert len(REFS) == len({w for w, _ in REFS})
    of = dict(REFS)
    for c in CATALOG:
        assert of[c.lower().replace(" ", "")] == c


def test_reference_table_equals_the_list(spark):
    catalog = spark.createDataFrame([(i + 1, c) for i, c in enumerate(CATALOG)] + [(99, None)], "type_id int, canonical string")
    assert {r.ref: CATALOG[r.target - 1] for r in m.reference_table(catalog).collect()} == dict(REFS)
