"""DuckDB SQL that says the same as the training-data queries, by brute force."""

from __future__ import annotations

from callweave.llm.canonical_map import normal_sql, reference_rows

#: The names of the reference list, for the SQL that cannot read it beforehand.
CATALOG = (
    "str", "int", "float", "bool", "list", "dict", "set", "tuple", "Any", "bytes", "date", "datetime", "Callable", "List[str]", "List[int]", "List[float]", "List[bool]",
    "List[List[int]]", "List[List[float]]", "List[Dict[str, Any]]", "List[Tuple[float, float]]", "Tuple[int, int]", "Tuple[float, float]", "Set[str]", "Set[int]",
    "Dict[str, str]", "Dict[str, int]", "Dict[str, float]", "Dict[str, Any]", "Union[int, float]", "Union[str, int]",
)


def _strict(column: str) -> str:
    bare = rf"""regexp_replace({column}, '"(\\.|[^"\\])*"', 's', 'g')"""
    return f"coalesce(json_valid({column}), false) AND NOT regexp_matches({bare}, '(?i)nan|inf|,\\s*[\\]}}]')"


def _text(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def _one_byte(column: str, letters: str) -> str:
    """DuckDB's levenshtein counts bytes: letters beyond ASCII become one-byte marks, the same on both sides."""
    return f"translate({column}, '{letters}', '{''.join(chr(2 + i) for i in range(len(letters)))}')"


def _mapped() -> str:
    letters = "".join(sorted({c for w, _ in reference_rows(list(CATALOG)) for c in w if not c.isascii()}))
    refs = ", ".join(f"({_text(w)}, {_text(c)})" for w, c in reference_rows(list(CATALOG)))
    swap = "length(v.value) = length(r.ref) AND list_sort(string_split(v.value, '')) = list_sort(string_split(r.ref, '')) AND levenshtein(v.value, r.ref) = 2"
    return f"""
refs AS (SELECT {_one_byte('ref', letters)} AS ref, type_id AS target FROM (VALUES {refs}) x(ref, canonical) JOIN type_catalog USING (canonical)),
raw AS (SELECT type, {_one_byte(normal_sql("type", "duckdb"), letters)} AS value FROM param_types WHERE type IS NOT NULL GROUP BY type),
v AS (SELECT DISTINCT value FROM raw),
hit AS (
  SELECT v.value, r.target, r.ref, least(levenshtein(v.value, r.ref), 1) AS edits FROM v JOIN refs r
  ON abs(length(v.value) - length(r.ref)) <= 1 AND ((length(v.value) >= 2 AND (levenshtein(v.value, r.ref) <= 1 OR ({swap}))) OR v.value = r.ref)),
best AS (SELECT value, min(struct_pack(e := edits, t := target)) AS b FROM hit GROUP BY value),
mapped AS (SELECT raw.type, coalesce(b.b.t, 0)::INT AS type_id FROM raw LEFT JOIN best b USING (value))"""


_CELLS = """
clean AS (
  SELECT row_index, id, nullif(regexp_replace(lower(trim(split, ' ')), '[\\s-]+', '_', 'g'), '') AS split, nullif(regexp_replace(lower(trim(call_bucket, ' ')), '[\\s-]+', '_', 'g'), '') AS call_bucket,
         nullif(regexp_replace(lower(trim(generator, ' ')), '[\\s-]+', '_', 'g'), '') AS generator FROM candidates),
usable AS (
  SELECT DISTINCT ON (id) id, split, call_bucket, generator FROM clean
  WHERE id IS NOT NULL AND split IS NOT NULL AND call_bucket IS NOT NULL AND generator IS NOT NULL ORDER BY id, row_index),
usable_rows AS (SELECT id, min(row_index) AS row_index FROM clean WHERE id IS NOT NULL AND split IS NOT NULL AND call_bucket IS NOT NULL AND generator IS NOT NULL GROUP BY id),
total AS (SELECT floor(count(*) / 4) AS size FROM usable),
cells AS (
  SELECT t.split, t.call_bucket, t.generator, greatest(t.min_rows, ceil(t.target_share * total.size)) AS needed,
         (SELECT count(*) FROM usable u WHERE u.split = t.split AND u.call_bucket = t.call_bucket AND u.generator = t.generator) AS available
  FROM sample_targets t, total)"""

_STEPS = 18


def _quotas() -> str:
    """Quotas step by step: cells whose floor or cap binds are fixed there, then largest remainders for the rest; as many steps as there are cells."""
    out = [
        """a0 AS (
  SELECT split, call_bucket, generator, target_share AS share, min_rows, needed, available AS cap, least(min_rows, available) AS low, (SELECT size FROM total) AS size,
         CASE WHEN available <= least(min_rows, available) OR target_share <= 0 THEN least(min_rows, available) END AS quota, row_number() OVER (ORDER BY split, call_bucket, generator) AS pos
  FROM cells JOIN sample_targets USING (split, call_bucket, generator))"""
    ]
    for i in range(_STEPS):
        out.append(f"""b{i} AS (
  SELECT *, CASE WHEN quota IS NULL THEN greatest(0, (size - sum(coalesce(quota, 0)) OVER ()) * share / sum(CASE WHEN quota IS NULL THEN share END) OVER ()) END AS ideal FROM a{i}),
c{i} AS (SELECT *, ideal >= cap AS over, ideal <= low AS under, coalesce(sum(CASE WHEN ideal >= cap THEN ideal - cap END) OVER (), 0) - coalesce(sum(CASE WHEN ideal <= low THEN low - ideal END) OVER (), 0) AS excess,
         coalesce(bool_or(ideal >= cap) OVER (), false) AS some_over, coalesce(bool_or(ideal <= low) OVER (), false) AS some_under FROM b{i}),
a{i + 1} AS (
  SELECT split, call_bucket, generator, share, min_rows, needed, cap, low, size, CASE WHEN quota IS NOT NULL THEN quota WHEN over AND some_over AND (excess >= 0 OR NOT some_under) THEN cap WHEN under AND some_under AND (excess < 0 OR NOT some_over) THEN low END AS quota, pos FROM c{i})""")
    out.append(f"""z AS (
  SELECT *, CASE WHEN quota IS NULL THEN greatest(0, (size - sum(coalesce(quota, 0)) OVER ()) * share / sum(CASE WHEN quota IS NULL THEN share END) OVER ()) END AS ideal, size - sum(coalesce(quota, 0)) OVER () AS rest FROM a{_STEPS}),
y AS (SELECT *, rest - sum(floor(ideal)) OVER () AS extra, row_number() OVER (ORDER BY ideal IS NULL, floor(ideal) - ideal, pos) AS place FROM z),
quotas AS (SELECT split, call_bucket, generator, share, min_rows, needed, cap, size, coalesce(quota, least(cap, floor(ideal) + (place <= extra)::INT))::BIGINT AS quota FROM y)""")
    return ",\n".join(out)


_SHARE = "10 * len(list_intersect(a.words, b.words)) >= 7 * (len(a.words) + len(b.words) - len(list_intersect(a.words, b.words)))"

_SETS = rf"""
v AS (SELECT row_index, query, tools::JSON AS tools FROM raw_rows WHERE query IS NOT NULL AND {_strict('tools')}),
n AS (
  SELECT row_index, list_distinct(regexp_extract_all(lower(query), '[a-z0-9]+')) AS words,
         list_distinct(list_filter(list_transform(json_extract(tools, '$[*]'), lambda t: trim(CASE WHEN json_type(t, '$.function') = 'OBJECT' THEN t->'function'->>'name' ELSE t->>'name' END)), lambda x: x IS NOT NULL)) AS names
  FROM v WHERE json_type(tools) = 'ARRAY'),
w AS (SELECT * FROM n WHERE len(words) > 0 AND len(names) > 0)"""
_SIMILAR = f"""10 * len(a.words) >= 7 * len(b.words) AND 10 * len(b.words) >= 7 * len(a.words) AND list_has_any(a.names, b.names)
  AND 2 * len(list_intersect(a.names, b.names)) >= len(a.names) + len(b.names) - len(list_intersect(a.names, b.names)) AND {_SHARE}"""

_REQUESTS = r"""
m AS (
  SELECT record_no, CASE WHEN lower(trim(metadata.split, ' ')) = 'train' THEN 't' WHEN lower(trim(metadata.split, ' ')) IN ('validation', 'test') THEN 'e' END AS side,
         list_distinct(regexp_extract_all(lower(list_filter(messages, lambda m: m.role = 'user')[1].content), '[a-z0-9]+')) AS words,
         flatten(list_transform(list_filter(messages, lambda m: m.role = 'assistant'), lambda m: coalesce(m.tool_calls, []))) AS calls
  FROM canonical_records),
c AS (SELECT record_no, unnest(calls) AS c, generate_subscripts(calls, 1) AS pos FROM m WHERE side IS NOT NULL),
k AS (
  SELECT record_no, pos, trim(any_value(c['function'].name)) || '(' || coalesce(string_agg(fullkey || '=' || value, ',' ORDER BY fullkey) FILTER (WHERE leaf), '') || ')' AS key
  FROM (SELECT c.*, j.fullkey, CASE WHEN j.type = 'DOUBLE' THEN (j.value::VARCHAR::DOUBLE)::VARCHAR ELSE j.value::VARCHAR END AS value,
               j.type NOT IN ('OBJECT', 'ARRAY') OR (j.value::VARCHAR IN ('{}', '[]') AND j.fullkey <> '$') AS leaf
        FROM c, LATERAL (SELECT fullkey, type, value FROM json_tree(c.c['function'].arguments::JSON)) j) GROUP BY ALL),
s AS (SELECT record_no, list_sort(list(key)) AS keys FROM k GROUP BY record_no),
w AS (SELECT m.record_no, side, words, coalesce(keys, []) AS keys FROM m LEFT JOIN s USING (record_no) WHERE side IS NOT NULL AND len(words) > 0)"""

SQL: dict[str, str] = {
    "p2_found": f"""
WITH {_REQUESTS}
SELECT least(a.record_no, b.record_no) AS record_a, greatest(a.record_no, b.record_no) AS record_b
FROM w a JOIN w b ON a.keys = b.keys AND a.side = 't' AND b.side = 'e' WHERE {_SHARE}""",
    "p2_report": f"""
WITH {_REQUESTS},
x AS (SELECT record_no, lower(trim(metadata.split, ' ')) AS split, coalesce(metadata.source_dataset, 'unknown') AS source FROM canonical_records),
p AS (
  SELECT xb.split, xb.source AS eval_source, xa.source AS train_source, b.record_no, list_sort(a.words) = list_sort(b.words) AS same
  FROM w a JOIN w b ON a.keys = b.keys AND a.side = 't' AND b.side = 'e' JOIN x xa ON xa.record_no = a.record_no JOIN x xb ON xb.record_no = b.record_no WHERE {_SHARE})
SELECT split, eval_source, train_source, count(*) AS pairs, count(*) FILTER (WHERE same) AS exact_pairs, count(DISTINCT record_no) AS eval_records FROM p GROUP BY ALL""",
    "p3_found": f"""
WITH {_mapped()}
SELECT p.param_id, m.type_id FROM param_types p JOIN mapped m ON p.type = m.type WHERE p.type NOT IN (SELECT canonical FROM type_catalog)""",
    "p3_unmatched": f"""
WITH {_mapped()}
SELECT p.type, count(*) AS n_rows FROM param_types p JOIN mapped m ON p.type = m.type WHERE m.type_id = 0 GROUP BY 1""",
    "p4_found": f"WITH {_CELLS} SELECT split, call_bucket, generator FROM cells WHERE available < needed",
    "p4_report": f"""WITH {_CELLS}, {_quotas()}
SELECT split, call_bucket, generator, share AS target_share, min_rows, needed::BIGINT AS needed, cap AS available, quota, quota AS drawn, quota / greatest(size, 1)::DOUBLE AS actual_share, greatest(0, needed - cap)::BIGINT AS shortfall FROM quotas""",
    "p4_sample": f"""WITH {_CELLS}, {_quotas()},
ranked AS (SELECT u.*, row_number() OVER (PARTITION BY split, call_bucket, generator ORDER BY md5('42-' || id), id) AS place FROM usable u)
SELECT r.id, k.row_index, r.split, r.call_bucket, r.generator FROM ranked r JOIN quotas USING (split, call_bucket, generator) JOIN usable_rows k USING (id) WHERE place <= quota""",
    "p5_found": f"WITH {_SETS} SELECT a.row_index AS row_a, b.row_index AS row_b FROM w a JOIN w b ON a.row_index < b.row_index AND {_SIMILAR}",
    "p5_groups": f"""
WITH RECURSIVE {_SETS},
c AS (SELECT row_index, words, names, min(row_index) OVER (PARTITION BY list_sort(words), list_sort(names)) AS class_id FROM w),
r AS (SELECT * FROM c WHERE row_index = class_id),
l AS (SELECT a.row_index AS x, b.row_index AS y FROM r a JOIN r b ON a.row_index <> b.row_index AND {_SIMILAR}),
reach(node, root) AS (SELECT row_index, row_index FROM r UNION SELECT l.y, reach.root FROM reach JOIN l ON l.x = reach.node),
g AS (SELECT node, min(root) AS group_id FROM reach GROUP BY node),
d AS (SELECT x, count(*) AS links FROM l GROUP BY x)
SELECT c.row_index, c.class_id, g.group_id, coalesce(d.links, 0) AS links FROM c JOIN g ON g.node = c.class_id LEFT JOIN d ON d.x = c.class_id""",
    "p8_found": """
WITH d AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT sum(size) AS total FROM d)
SELECT m.source FROM mix_targets m LEFT JOIN d USING (source), t WHERE m.max_repeats * coalesce(d.size, 0) < m.target_share * t.total""",
    "p8_needs": """
WITH d AS (SELECT source, sum(length(coalesce(text, ''))) AS size FROM documents WHERE source IS NOT NULL GROUP BY 1),
t AS (SELECT sum(size) AS total FROM d)
SELECT m.source, m.target_share, m.max_repeats, coalesce(d.size, 0)::BIGINT AS size, t.total::DOUBLE AS total, m.target_share * t.total::DOUBLE AS wanted, CASE WHEN d.size > 0 THEN least(m.max_repeats::DOUBLE, m.target_share * t.total::DOUBLE / d.size) ELSE 0 END AS copies
FROM mix_targets m LEFT JOIN d USING (source), t""",
}
