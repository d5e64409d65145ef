"""DuckDB SQL that says the same as the core queries."""

from __future__ import annotations

from callweave.plans import chat_oracles

_CLEAN = "lower(trim({}, ' '))"
_CAND = f"(SELECT * REPLACE ({_CLEAN.format('split')} AS split, {_CLEAN.format('generator')} AS generator, regexp_replace({_CLEAN.format('call_bucket')}, '[ -]', '_', 'g') AS call_bucket) FROM candidates)"
_ELIGIBLE = f"SELECT DISTINCT ON (id) * FROM {_CAND} WHERE id IS NOT NULL AND generator IS NOT NULL AND call_bucket IS NOT NULL AND fingerprint IS NOT NULL ORDER BY id, row_index"
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_CALLS = """(SELECT record_no, tools, list_filter(flatten(list_transform(coalesce(messages, []), lambda m: coalesce(m.tool_calls, []))), lambda c: c IS NOT NULL) AS calls FROM canonical_records)"""
_NAMES = f"(SELECT record_no, list_transform(calls, lambda c: c['function'].name) AS names, list_transform(tools, lambda t: t['function'].name) AS known FROM {_CALLS})"
_RANK = "CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE 3 END"


def strict_json(column: str) -> str:
    """SQL: a text is standard JSON. DuckDB also takes NaN, Infinity and trailing commas; these are told outside strings."""
    bare = rf"""regexp_replace({column}, '"(\\.|[^"\\])*"', 's', 'g')"""
    return f"coalesce(json_valid({column}), false) AND NOT regexp_matches({bare}, '(?i)nan|inf|,\\s*[\\]}}]')"


_READABLE = f"""
  SELECT row_index, tools::JSON AS tools, answers::JSON AS answers FROM raw_rows
  WHERE {strict_json('tools')} AND {strict_json('answers')}"""
_BODIES = """
  SELECT row_index, t.pos - 1 AS pos, CASE WHEN json_type(t.tool, '$.function') = 'OBJECT' THEN t.tool->'function' ELSE t.tool END AS body
  FROM r, LATERAL (SELECT unnest(json_extract(r.tools, '$[*]')) AS tool, generate_subscripts(json_extract(r.tools, '$[*]'), 1) AS pos) t"""

_LINES = rf"""
WITH f AS (SELECT line_id, line, '("([^"]|"")*"|[^",][^,"]*|)' AS fld FROM raw_lines),
q AS (SELECT line_id, line, regexp_full_match(line, '(?s)' || fld || '(,' || fld || ')*') AS quoted FROM f),
s AS (
  SELECT line_id, line, quoted, CASE WHEN quoted THEN regexp_extract_all(',' || line, '(?s),("(?:[^"]|"")*"|[^,]*)', 1) END AS parts FROM q),
u AS (
  SELECT line_id, line, quoted, list_transform(parts, lambda x: CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM s),
w AS (
  SELECT line_id, line, quoted, len(v) AS n, trim(v[1], ' ') AS id, v[2] AS query, v[3] AS tools, v[4] AS answers FROM u),
g AS (
  SELECT *, {strict_json('tools')} AS tools_valid, {strict_json('answers')} AS answers_valid FROM w),
j AS (
  SELECT *, CASE WHEN tools_valid THEN tools::JSON END AS tj, CASE WHEN answers_valid THEN answers::JSON END AS aj FROM g),
judged AS (
  SELECT line_id, id, query, tools, answers, CASE
    WHEN line IS NULL THEN 'column_count'
    WHEN NOT quoted THEN 'quoting'
    WHEN n <> 4 THEN 'column_count'
    WHEN NOT regexp_full_match(id, '[0-9]+') OR try_cast(id AS HUGEINT) IS NULL OR try_cast(id AS HUGEINT) > 9223372036854775807 THEN 'id'
    WHEN NOT coalesce(tools_valid AND json_type(tj) = 'ARRAY' AND json_array_length(tj) > 0 AND len(list_filter(json_extract(tj, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0, false) THEN 'tools'
    WHEN NOT coalesce(answers_valid AND json_type(aj) = 'ARRAY' AND json_array_length(aj) > 0 AND len(list_filter(json_extract(aj, '$[*]'), lambda x: json_type(x) <> 'OBJECT')) = 0, false) THEN 'answers'
  END AS reason FROM j)"""

# equal queries (case and blanks aside) with equal tools: the leaves of the JSON in order of their paths
_SAME = rf"""trim(regexp_replace(lower(query), '{_SPACE}', ' ', 'g'), ' ') || chr(1) || coalesce((SELECT string_agg(k.fullkey || '=' || k.type || k.value::VARCHAR, chr(2) ORDER BY k.fullkey) FROM json_tree(tools) k WHERE k.type NOT IN ('OBJECT', 'ARRAY') OR k.value::VARCHAR IN ('{{}}', '[]')), '')"""
# what stands in the columns of a readable raw row; names of items that are objects only
_FIELDS = rf"""
  SELECT row_index, id, query, source_dataset, CASE WHEN {strict_json('tools')} THEN tools::JSON END AS tools, CASE WHEN {strict_json('answers')} THEN answers::JSON END AS answers,
         tools IS NOT NULL AND NOT {strict_json('tools')} AS bad_tools, answers IS NOT NULL AND NOT {strict_json('answers')} AS bad_answers FROM raw_rows"""
_PROFILE = rf"""
f AS ({_FIELDS}),
rd AS (SELECT * FROM f WHERE id IS NOT NULL AND regexp_matches(query, '[^{_SPACE[1:-2]}]') AND json_type(tools) = 'ARRAY' AND json_array_length(tools) > 0 AND json_type(answers) = 'ARRAY' AND json_array_length(answers) > 0),
items AS (
  SELECT *, json_extract(tools, '$[*]') AS tool_items, json_extract(answers, '$[*]') AS call_items FROM rd),
pr AS (
  SELECT row_index, query, tools, source_dataset, len(tool_items) AS available_tool_count, len(call_items) AS expected_call_count,
         list_sort(list_distinct(list_filter(list_transform(tool_items, lambda t: t->>'name'), lambda x: x IS NOT NULL))) AS available_tool_names,
         list_filter(list_transform(call_items, lambda t: t->>'name'), lambda x: x IS NOT NULL) AS expected_tool_names,
         '[' || array_to_string(list_transform(call_items, lambda t: CASE WHEN json_type(t, '$.arguments') = 'OBJECT' THEN to_json(list_sort(json_keys(t, '$.arguments')))::VARCHAR ELSE '[]' END), ',') || ']' AS argument_keys,
         flatten(list_transform(list_filter(tool_items, lambda t: json_type(t, '$.parameters') = 'OBJECT'), lambda t: list_filter(json_extract(t, '$.parameters.*'), lambda x: json_type(x) = 'OBJECT'))) AS specs
  FROM items),
pf AS (
  SELECT *, list_sort(list_filter(list_distinct(expected_tool_names), lambda x: NOT list_contains(available_tool_names, x))) AS unknown_answer_tools,
         list_transform(specs, lambda x: coalesce(x->>'type', CASE WHEN json_type(x, '$.type') = 'NULL' THEN 'None' ELSE '<missing>' END)) AS type_occurrences,
         list_sort(list_distinct(list_filter(list_transform(specs, lambda x: x->>'type'), lambda x: x IS NOT NULL))) AS parameter_types, len(list_distinct(expected_tool_names)) AS called FROM pr)"""

# predicted calls after the edit of record_no modulo 8 (see the query); k0: argument names of the first call
_SCORED = f"""
SELECT record_no, split, n, edit, n > 0 AND edit NOT IN (5, 7) AND NOT (edit = 6 AND n = 1) AS valid, CASE edit WHEN 6 THEN greatest(n - 1, 0) WHEN 7 THEN 0 ELSE n END AS predicted,
       edit IN (0, 1) OR (edit = 4 AND k0 = 0) AS whole, edit IN (0, 1, 3, 4) AS names, edit IN (0, 1, 2, 4) AS keys, edit IN (0, 1, 2) OR (edit = 4 AND k0 = 0) AS vals,
       called, args, list_transform(args, lambda a: list_sort(json_keys(a::JSON))) AS arg_keys
FROM (SELECT record_no, record_no % 8 AS edit, len(calls) AS n, list_transform(calls, lambda c: c['function'].name) AS called, list_transform(calls, lambda c: c['function'].arguments) AS args,
             coalesce(len(json_keys(calls[1]['function'].arguments::JSON)), 0) AS k0 FROM {_CALLS})
JOIN (SELECT record_no, lower(trim(metadata.split, ' ')) AS split FROM canonical_records) USING (record_no)"""
_POOL = f"""
c AS (SELECT row_index, id, generator, call_bucket, fingerprint, md5('42-' || id) AS key FROM ({_ELIGIBLE})),
d AS (SELECT *, row_number() OVER (PARTITION BY generator, call_bucket, fingerprint ORDER BY key, row_index) AS k FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY generator, call_bucket ORDER BY key, row_index) AS pool_pos FROM d WHERE k = 1)"""
# places of the default quotas in each pool, one split after the other
_SELECTED = f"""{_POOL},
q AS (SELECT * FROM (VALUES ('single_call', 36, 12), ('two_calls', 15, 5), ('three_or_more_calls', 9, 3)) x(call_bucket, train, other)),
sel AS (
  SELECT CASE WHEN pool_pos <= train THEN 'train' WHEN pool_pos <= train + other THEN 'validation' ELSE 'test' END AS split, id, row_index, generator, call_bucket
  FROM h JOIN q USING (call_bucket) WHERE pool_pos <= train + 2 * other AND generator IN ('deepseek', 'mixtral'))"""
_PICKED = """
n AS (
  SELECT id, metadata.source_id AS source_id, CASE split WHEN 'train' THEN 0 WHEN 'validation' THEN 1 WHEN 'test' THEN 2 ELSE 3 END AS rank, names, len(known) AS tools,
    len(list_filter(list_transform(tools, lambda t: t['function'].parameters::JSON), lambda p:
      len(list_filter(json_extract(p, '$.properties.*'), lambda x: regexp_matches(x::VARCHAR, '"type": ?"(array|object)"|"anyOf"'))) > 0)) > 0 AS nested
  FROM {names} JOIN (SELECT record_no, id, tools, metadata, lower(trim(metadata.split, ' ')) AS split FROM canonical_records) USING (record_no) WHERE split IS NOT NULL AND metadata.source_id IS NOT NULL),
o AS (SELECT id, rank, source_id, CASE k WHEN 0 THEN len(names) = 1 WHEN 1 THEN len(names) = 2 AND len(list_distinct(names)) >= 2 WHEN 2 THEN len(names) >= 3 WHEN 3 THEN len(names) > len(list_distinct(names)) ELSE tools >= 5 AND nested END AS fits, k FROM n, range(5) r(k)),
e AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY min((rank, source_id)), id) AS pos FROM o WHERE fits GROUP BY k, id)"""


def _first_free(rows: str, steps: list[str]) -> str:
    """CTEs that take, step by step, the first of `rows` (k, id, pos) that no earlier step took."""
    out = []
    for i in range(len(steps)):
        earlier = " UNION ALL ".join(f"SELECT id FROM s{j}" for j in range(i)) or "SELECT NULL WHERE false"
        out.append(f"s{i} AS (SELECT {i} AS k, arg_min(id, pos) AS id FROM {rows} WHERE k = {i} AND id NOT IN ({earlier}))")
    return ",\n".join(out)


_REPRESENTED = ("single_call", "two_calls_distinct_tools", "three_plus_calls", "repeated_tool_calls", "five_plus_available_tools")
_CATEGORIES = ("single_call", "exactly_two_calls", "three_or_more_calls", "many_available_tools", "complex_parameter_type")

_NESTED = rf"""
WITH r AS ({_READABLE}), b AS ({_BODIES}),
p AS (
  SELECT row_index, pos, CASE WHEN json_type(body, '$.parameters.type') = 'VARCHAR' THEN body->'parameters'->'properties' ELSE body->'parameters' END AS params
  FROM b WHERE json_type(body, '$.parameters') = 'OBJECT'),
declared AS (
  SELECT row_index, pos, json_extract(p.params, k.fullkey) AS decl, replace(substr(k.fullkey, 3), '"', '') AS key, k.fullkey FROM p, LATERAL (SELECT fullkey FROM json_tree(p.params)) k
  WHERE json_type(p.params) = 'OBJECT'
    AND regexp_full_match(k.fullkey, '\$\.[^.\[]+((\.items)*\.properties\.[^.\[]+)*')),
first AS (SELECT row_index, trim(body->>'name') AS name, min(pos) AS pos FROM b WHERE json_type(body, '$.name') = 'VARCHAR' GROUP BY ALL),
c AS (
  SELECT row_index, a.pos - 1 AS pos, trim(a.call->>'name') AS name,
         CASE WHEN json_type(a.call, '$.arguments') = 'VARCHAR' THEN (a.call->>'arguments')::JSON ELSE a.call->'arguments' END AS args
  FROM r, LATERAL (SELECT unnest(json_extract(r.answers, '$[*]')) AS call, generate_subscripts(json_extract(r.answers, '$[*]'), 1) AS pos) a),
leaf AS (
  SELECT c.row_index, c.pos, c.name, replace(ltrim(substr(k.fullkey, 2), '.'), '"', '') AS path, k.type, k.fullkey
  FROM c, LATERAL (SELECT fullkey, type, value FROM json_tree(c.args)) k
  WHERE json_type(c.args) IN ('OBJECT', 'ARRAY') AND k.fullkey <> '$' AND (k.type NOT IN ('OBJECT', 'ARRAY') OR k.value::VARCHAR IN ('{{}}', '[]')))"""
# every node with its variant: what stands in a declaration, in the parameters of a tool, in the arguments of a call
_NODES = rf"""{_NESTED},
t AS (
  SELECT row_index, json_type(t.tool) = 'OBJECT' AS is_object, json_type(t.tool, '$.function') = 'OBJECT' AS wrapped,
         CASE WHEN json_type(t.tool, '$.function') = 'OBJECT' THEN t.tool->'function' ELSE t.tool END AS body
  FROM r, LATERAL (SELECT unnest(json_extract(r.tools, '$[*]')) AS tool) t),
a AS (SELECT row_index, a.call FROM r, LATERAL (SELECT unnest(json_extract(r.answers, '$[*]')) AS call) a),
nodes AS (
  SELECT row_index, 'record' AS kind, CASE WHEN row_index IN (SELECT row_index FROM r) THEN 'readable' ELSE 'unreadable' END AS variant, 0 AS depth FROM raw_rows
  UNION ALL
  SELECT row_index, 'tool', CASE WHEN NOT is_object THEN 'other' ELSE CASE WHEN wrapped THEN 'wrapped_' ELSE '' END || CASE
           WHEN coalesce(json_type(body, '$.parameters') <> 'OBJECT' OR len(json_keys(body, '$.parameters')) = 0, true) THEN 'bare'
           WHEN json_type(body, '$.parameters.type') = 'VARCHAR' THEN 'schema' ELSE 'flat' END END, 1 FROM t
  UNION ALL
  SELECT row_index, 'param', CASE
           WHEN json_type(decl, '$.properties') = 'OBJECT' THEN 'object'
           WHEN json_type(decl, '$.items.properties') = 'OBJECT' OR json_type(decl, '$.items.items.properties') = 'OBJECT' OR json_type(decl, '$.items.items.items.properties') = 'OBJECT' THEN 'array_of_objects'
           WHEN json_type(decl, '$.items') IS NOT NULL THEN 'array'
           WHEN json_type(decl, '$.type') = 'VARCHAR' THEN 'scalar' ELSE 'untyped' END, 2 + len(regexp_extract_all(fullkey, '\.properties\.')) FROM declared
  UNION ALL
  SELECT row_index, 'call', CASE
           WHEN json_type(call) <> 'OBJECT' THEN 'other'
           WHEN coalesce(json_type(call, '$.arguments'), 'NULL') = 'NULL' OR (call->'arguments')::VARCHAR = '{{}}' THEN 'empty'
           WHEN json_type(call, '$.arguments') = 'OBJECT' THEN 'object'
           WHEN json_type(call, '$.arguments') = 'VARCHAR' AND {strict_json("(call->>'arguments')")} THEN 'text' ELSE 'other' END, 1 FROM a
  UNION ALL
  SELECT row_index, 'arg', CASE WHEN type = 'VARCHAR' THEN 'string' WHEN type IN ('OBJECT', 'ARRAY') THEN 'empty_' || lower(type) WHEN type IN ('BOOLEAN', 'NULL') THEN lower(type) ELSE 'number' END,
         1 + len(regexp_extract_all(fullkey, '\.("[^"]*"|[^.\[]+)|\[[0-9]+\]')) FROM leaf)"""

SQL: dict[str, str] = {
    "p1_found": f"""{_NESTED}
SELECT row_index, 'param' AS child, pos::INT AS pos, pos::INT AS tool_pos, replace(replace(key, '.items', '[]'), '.properties.', '.') AS path FROM declared
UNION ALL
SELECT l.row_index, 'arg', l.pos::INT, coalesce(f.pos, -1)::INT, l.path FROM leaf l LEFT JOIN first f ON f.row_index = l.row_index AND f.name = l.name""",
    "p1_variants": f"""{_NODES}
SELECT kind, variant, count(*) AS nodes, count(DISTINCT row_index) AS records, max(depth)::INT AS max_depth FROM nodes GROUP BY ALL""",
    "p1_subtypes": f"""{_NODES}
SELECT kind || '_' || variant AS subtype, count(*) AS n_rows, CASE WHEN kind = 'record' THEN 0 ELSE count(*) END AS with_parent FROM nodes GROUP BY kind, variant""",
    "p6_found": f"{_LINES} SELECT line_id, reason FROM judged WHERE reason IS NOT NULL",
    "p6_loaded": f"{_LINES} SELECT line_id, id::BIGINT AS id, query, tools, answers FROM judged WHERE reason IS NULL",
    "call_bucket_distribution": """
SELECT CASE WHEN expected_call_count = 1 THEN 'single_call' WHEN expected_call_count = 2 THEN 'two_calls' WHEN expected_call_count >= 3 THEN 'three_or_more_calls' ELSE 'zero_calls' END AS bucket,
       count(*) AS n FROM candidates GROUP BY 1""",
    "generator_distribution": f"SELECT generator, count(*) AS n FROM {_CAND} WHERE generator IS NOT NULL GROUP BY 1",
    "generator_by_id": "SELECT CASE WHEN id < 33659 THEN 'deepseek' ELSE 'mixtral' END AS generator, count(*) AS n FROM raw_rows WHERE id IS NOT NULL GROUP BY 1",
    "tool_count_distribution": """
SELECT measure, value, count(*) AS n FROM (
  SELECT 'tools' AS measure, available_tool_count::BIGINT AS value FROM candidates UNION ALL SELECT 'calls', expected_call_count::BIGINT FROM candidates)
WHERE value IS NOT NULL GROUP BY ALL""",
    "parameter_type_counts": "SELECT type, count(*) AS n FROM (SELECT row_index, unnest(list_distinct(parameter_types)) AS type FROM candidates) WHERE type IS NOT NULL GROUP BY 1",
    "parameter_type_occurrences": "SELECT coalesce(type, '<missing>') AS type, count(*) AS n FROM param_types GROUP BY 1",
    "complex_parameter_flag": "SELECT row_index, coalesce(len(list_filter(parameter_types, lambda t: regexp_matches(lower(t), 'array|dict|list|object'))) > 0, false) AS is_complex FROM candidates",
    "distinct_tool_flags": """
SELECT row_index, expected_call_count > 1 AND distinct_expected_tool_count = 1 AS repeated_same, distinct_expected_tool_count > 1 AS multiple_distinct
FROM candidates WHERE expected_call_count IS NOT NULL AND distinct_expected_tool_count IS NOT NULL""",
    "namespace_topk": """
SELECT namespace, n, first_row FROM (
  SELECT split_part(tool_name, '.', 1) AS namespace, count(*) AS n, min(row_index) AS first_row FROM param_types WHERE tool_name IS NOT NULL AND tool_name <> '' GROUP BY 1)
ORDER BY n DESC, first_row, namespace LIMIT 30""",
    "fingerprint_documents": f"SELECT doc_id, sha256(trim(regexp_replace(lower(text), '{_SPACE}', ' ', 'g'), ' ')) AS fingerprint FROM documents WHERE text IS NOT NULL",
    "duplicate_fingerprints": "SELECT fingerprint, count(*) AS n, min(row_index) AS first_row FROM candidates WHERE fingerprint IS NOT NULL GROUP BY 1 HAVING count(*) > 1",
    "token_estimate": "SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL",
    "context_limit_filter": "SELECT doc_id, greatest(1, ceil(length(text) / 4.0))::BIGINT AS tokens FROM documents WHERE text IS NOT NULL AND ceil(length(text) / 4.0) > 8192",
    "cross_split_duplicates": f"""
WITH r AS (SELECT id, split, fingerprint, {_RANK} AS rank FROM {_CAND} WHERE split IS NOT NULL AND fingerprint IS NOT NULL),
o AS (SELECT fingerprint, min(rank) AS first, arg_min(split, rank) AS owner FROM r GROUP BY 1)
SELECT id, split, owner, fingerprint FROM r JOIN o USING (fingerprint) WHERE rank > first""",
    "split_verification": f"""
WITH c AS (SELECT id, split FROM {_CAND} WHERE split IS NOT NULL),
s AS (SELECT id FROM c WHERE id IS NOT NULL GROUP BY id HAVING count(DISTINCT split) > 1)
SELECT split, count(*) AS n, count(DISTINCT id) AS ids, count(DISTINCT CASE WHEN id IN (SELECT id FROM s) THEN id END) AS shared_ids FROM c GROUP BY split""",
    "split_id_match": f"""
WITH a AS (SELECT split, id, count(*) AS n FROM {_CAND} WHERE id IS NOT NULL AND split IS NOT NULL GROUP BY ALL),
b AS (SELECT lower(trim(metadata.split, ' ')) AS split, metadata.source_id AS id, count(*) AS n FROM canonical_records WHERE metadata.source_id IS NOT NULL AND metadata.split IS NOT NULL GROUP BY ALL)
SELECT coalesce(a.split, b.split) AS split, coalesce(a.id, b.id) AS id, coalesce(a.n, 0) AS n_left, coalesce(b.n, 0) AS n_right
FROM a FULL JOIN b ON a.split = b.split AND a.id = b.id WHERE coalesce(a.n, 0) <> coalesce(b.n, 0)""",
    "arrival_counts": """
SELECT strftime(ingested_at, '%Y-%m-%d') AS day, count(*) AS n, count(*) FILTER (WHERE ingested_at > created_at + INTERVAL 1 DAY) AS late
FROM raw_rows WHERE ingested_at IS NOT NULL GROUP BY 1""",
    "expected_calls": f"""
SELECT record_no, (pos - 1)::INT AS call_pos, c['function'].name AS name, c['function'].arguments AS arguments
FROM (SELECT record_no, unnest(calls) AS c, generate_subscripts(calls, 1) AS pos FROM {_CALLS})""",
    "call_membership": f"SELECT record_no, len(names)::INT AS calls, len(list_filter(names, lambda n: list_contains(known, n)))::INT AS known_calls FROM {_NAMES}",
    "repeated_calls": f"SELECT record_no, len(names) > len(list_distinct(names)) AS repeated_tool_calls, len(list_distinct(names)) >= 2 AS multiple_called_tools FROM {_NAMES}",
    "feature_tags": rf"""
WITH n AS (
  SELECT record_no, names, len(known) AS tools,
    len(list_filter(list_transform(tools, lambda t: t['function'].parameters::JSON), lambda p:
      len(list_filter(json_extract(p, '$.properties.*'), lambda x: regexp_matches(x::VARCHAR, '"type": ?"(array|object)"|"anyOf"'))) > 0)) > 0 AS nested
  FROM {_NAMES} JOIN (SELECT record_no, tools FROM canonical_records) USING (record_no))
SELECT record_no, concat_ws(',',
  CASE len(names) WHEN 1 THEN 'single_call' WHEN 2 THEN 'two_calls' ELSE 'three_plus_calls' END,
  CASE WHEN len(list_distinct(names)) >= 2 THEN 'multiple_called_tools' END,
  CASE WHEN len(names) > len(list_distinct(names)) THEN 'repeated_tool_calls' END,
  CASE WHEN tools >= 5 THEN 'five_plus_available_tools' END,
  CASE WHEN nested THEN 'complex_parameter_types' END) AS tags FROM n""",
    "document_markers": r"""
WITH m AS (SELECT doc_id, text, ['<tools>', '</tools>', '<|tools_start|>', '<|tools_end|>', '<tool_call>', '</tool_call>', '<|tool_call_start|>', '<|tool_call_end|>'] AS tags FROM documents WHERE text IS NOT NULL),
f AS (SELECT doc_id, text, list_filter(tags, lambda t: contains(text, t)) AS marks, regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1) AS thoughts FROM m)
SELECT doc_id, array_to_string(marks, ' ') AS marks,
  CASE WHEN len(thoughts) > 0 THEN len(list_filter(thoughts, lambda x: regexp_matches(x, '\S'))) > 0
       ELSE contains(text, '<|thinking|>') OR contains(text, '<|think_start|>') OR contains(text, '<|think_end|>') END AS has_thinking
FROM f WHERE len(marks) > 0""",
    "delimiters": """
WITH m AS (SELECT coalesce(source, 'unknown') AS source, text, unnest(['<tools>', '</tools>', '<|tools_start|>', '<|tools_end|>', '<tool_call>', '</tool_call>', '<|tool_call_start|>', '<|tool_call_end|>']) AS mark FROM documents WHERE text IS NOT NULL)
SELECT source, mark, count(*) AS n FROM m WHERE contains(text, mark) GROUP BY ALL""",
    "thinking_check": r"""
WITH f AS (SELECT text, regexp_extract_all(text, '(?s)<think>(.*?)</think>', 1) AS thoughts FROM documents WHERE text IS NOT NULL)
SELECT CASE WHEN len(thoughts) > 0 THEN len(list_filter(thoughts, lambda x: regexp_matches(x, '\S'))) > 0
  ELSE contains(text, '<|thinking|>') OR contains(text, '<|think_start|>') OR contains(text, '<|think_end|>') END AS has_thinking, count(*) AS n FROM f GROUP BY 1""",
    "json_props_decode": "SELECT event_type, try_cast(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n FROM events GROUP BY ALL",
    "first_of_id": "SELECT id, min(row_index) AS first_row, count(*) AS n FROM raw_rows WHERE id IS NOT NULL GROUP BY 1",
    "pool_sizes": f"WITH c AS ({_ELIGIBLE}) SELECT generator, call_bucket, count(*) AS n FROM c GROUP BY ALL",
    "pool_heads": f"""
WITH c AS (
  SELECT row_index, id, generator, call_bucket, fingerprint, md5('42-' || id) AS key FROM ({_ELIGIBLE})),
d AS (SELECT *, row_number() OVER (PARTITION BY generator, call_bucket, fingerprint ORDER BY key, row_index) AS k FROM c),
h AS (SELECT *, row_number() OVER (PARTITION BY generator, call_bucket ORDER BY key, row_index) AS pool_pos FROM d WHERE k = 1)
SELECT generator, call_bucket, pool_pos::INT AS pool_pos, row_index, id, fingerprint FROM h WHERE pool_pos <= 200""",
    "raw_profile": f"WITH {_PROFILE} SELECT source_dataset, count(*) AS n, count(p.row_index) AS readable, count(DISTINCT p.same) AS fingerprints FROM f LEFT JOIN (SELECT row_index, {_SAME} AS same FROM pf) p USING (row_index) GROUP BY 1",
    "raw_parameter_types": f"WITH {_PROFILE} SELECT type, count(*) AS n FROM (SELECT unnest(type_occurrences) AS type FROM pf) GROUP BY 1",
    "unknown_tools": f"WITH {_PROFILE} SELECT row_index, unnest(unknown_answer_tools) AS tool FROM pf",
    "derived_analysis": f"""WITH {_PROFILE}
SELECT row_index, available_tool_count::INT AS available_tool_count, expected_call_count::INT AS expected_call_count, available_tool_names, expected_tool_names, unknown_answer_tools, parameter_types,
       CASE expected_call_count WHEN 1 THEN 'single_call' WHEN 2 THEN 'two_calls' ELSE 'three_or_more_calls' END AS call_bucket, called::INT AS distinct_expected_tool_count,
       expected_call_count > 1 AND called = 1 AS repeated_same_tool, called > 1 AS multiple_distinct_tools,
       len(list_filter(parameter_types, lambda t: regexp_matches(lower(t), 'array|dict|list|object'))) > 0 AS has_complex_parameters, argument_keys, expected_call_count > 1 AS needs_review FROM pf""",
    "record_fingerprints": f"WITH {_PROFILE}, k AS (SELECT row_index, {_SAME} AS same FROM pf) SELECT row_index, min(row_index) OVER w AS first_row, count(*) OVER w AS n FROM k WINDOW w AS (PARTITION BY same)",
    "inspection_profile": f"""WITH {_PROFILE},
x AS (
  SELECT *, CASE WHEN query IS NULL THEN 'query_not_string' WHEN NOT regexp_matches(query, '[^{_SPACE[1:-2]}]') THEN 'query_empty' WHEN bad_tools THEN 'tools_invalid_json' WHEN bad_answers THEN 'answers_invalid_json'
            WHEN tools IS NULL OR json_type(tools) <> 'ARRAY' THEN 'tools_not_list' WHEN answers IS NULL OR json_type(answers) <> 'ARRAY' THEN 'answers_not_list' ELSE 'none' END AS fault FROM f),
y AS (SELECT json_extract(tools, '$[*]') AS t, json_extract(answers, '$[*]') AS c FROM x WHERE fault = 'none'),
o AS (SELECT u AS t FROM y, LATERAL (SELECT unnest(y.t) AS u)),
z AS (
  SELECT 'fault' AS measure, fault AS value FROM x
  UNION ALL SELECT 'fault', 'tool_not_object' FROM o WHERE json_type(t) <> 'OBJECT'
  UNION ALL SELECT 'tools', len(t)::VARCHAR FROM y UNION ALL SELECT 'calls', len(c)::VARCHAR FROM y
  UNION ALL SELECT 'namespace', split_part(t->>'name', '.', 1) FROM o WHERE json_type(t, '$.name') = 'VARCHAR' AND t->>'name' <> ''
  UNION ALL SELECT 'parameter_type', coalesce(s->>'type', CASE WHEN json_type(s, '$.type') = 'NULL' THEN 'None' ELSE '<missing>' END) FROM o, LATERAL (SELECT unnest(json_extract(o.t, '$.parameters.*')) AS s) WHERE json_type(t, '$.parameters') = 'OBJECT' AND json_type(s) = 'OBJECT')
SELECT measure, value, count(*) AS n FROM z GROUP BY ALL""",
    "record_token_estimate": """
SELECT record_no, greatest(1, ceil(length('{"messages":[' || array_to_string(list_transform(messages, lambda m:
         '{"content":' || to_json(coalesce(m.content, ''))::VARCHAR || ',"role":' || to_json(coalesce(m.role, ''))::VARCHAR || CASE WHEN len(m.tool_calls) > 0 THEN ',"tool_calls":[' || array_to_string(list_transform(m.tool_calls, lambda c:
           '{"function":{"arguments":' || json(c['function'].arguments)::VARCHAR || ',"name":' || to_json(c['function'].name)::VARCHAR || '},"id":' || coalesce(to_json(c.id)::VARCHAR, 'null') || ',"type":' || coalesce(to_json(c.type)::VARCHAR, 'null') || '}'), ',') || ']' ELSE '' END || '}'), ',')
       || '],"tools":[' || array_to_string(list_transform(tools, lambda t: '{"function":{' || concat_ws(',', '"description":' || to_json(t['function'].description)::VARCHAR, '"name":' || to_json(t['function'].name)::VARCHAR, '"parameters":' || json(t['function'].parameters)::VARCHAR)
         || '},"type":' || coalesce(to_json(t.type)::VARCHAR, 'null') || '}'), ',') || ']}') / 4.0))::INT AS tokens, NULL::VARCHAR AS error FROM canonical_records""",
    "selected_records": f"WITH {_SELECTED} SELECT id, generator, call_bucket, split FROM sel",
    "selection_summary": f"""WITH {_SELECTED}, {_PROFILE},
j AS (SELECT s.split, c.* EXCLUDE (split), p.unknown_answer_tools AS unknown FROM sel s JOIN {_CAND} c USING (row_index) LEFT JOIN pf p USING (row_index)),
z AS (
  SELECT unnest(['split', 'generator', 'call_bucket', 'expected_calls', 'available_tools', 'five_or_more_tools', 'complex_parameters', 'multiple_tools', 'repeated_tool', 'unknown_tools']) AS measure,
         unnest([split, generator, call_bucket, expected_call_count::VARCHAR, available_tool_count::VARCHAR, (available_tool_count >= 5)::VARCHAR, has_complex_parameters::VARCHAR, multiple_distinct_tools::VARCHAR, repeated_same_tool::VARCHAR, (len(unknown) > 0)::VARCHAR]) AS value FROM j
  UNION ALL SELECT 'parameter_type', unnest(parameter_types) FROM j)
SELECT measure, value, count(*) AS n FROM z GROUP BY ALL
UNION ALL
SELECT 'short', s || '/' || g || '/' || call_bucket, want - have FROM (
  SELECT s, g, q.call_bucket, CASE WHEN s = 'train' THEN train ELSE other END AS want, (SELECT count(*) FROM sel WHERE sel.split = s AND sel.generator = g AND sel.call_bucket = q.call_bucket) AS have
  FROM q, (SELECT unnest(['train', 'validation', 'test']) AS s), (SELECT unnest(['deepseek', 'mixtral']) AS g)) WHERE want > have""",
    "category_examples": f"""WITH
o AS (SELECT row_index AS id, md5('42-' || row_index) AS key, k, CASE k WHEN 0 THEN expected_call_count = 1 WHEN 1 THEN expected_call_count = 2 WHEN 2 THEN expected_call_count >= 3 WHEN 3 THEN available_tool_count >= 5 ELSE has_complex_parameters END AS fits FROM candidates, range(5) r(k)),
e AS (SELECT k, id, row_number() OVER (PARTITION BY k ORDER BY key, id) AS pos FROM o WHERE fits),
{_first_free("e", list(_CATEGORIES))}
SELECT category, id AS row_index FROM ({" UNION ALL ".join(f"SELECT '{c}' AS category, id FROM s{i}" for i, c in enumerate(_CATEGORIES))}) WHERE id IS NOT NULL""",
    "representative_pick": f"""WITH {_PICKED.format(names=_NAMES)},
{_first_free("e", list(_REPRESENTED))}
SELECT (row_number() OVER (ORDER BY k) - 1)::INT AS pos, feature, id FROM ({" UNION ALL ".join(f"SELECT {i} AS k, '{c}' AS feature, id FROM s{i}" for i, c in enumerate(_REPRESENTED))}) WHERE id IS NOT NULL""",
    "score_unordered": f"""
SELECT record_no, valid AS valid_structure, valid AND names AS correct_function_name, valid AND keys AS correct_argument_names, valid AND vals AS correct_argument_values, valid AND whole AS complete_call_match,
       predicted::INT AS predicted_count, n::INT AS expected_count, (CASE WHEN NOT valid THEN 0 WHEN whole THEN n ELSE n - 1 END)::INT AS matched FROM ({_SCORED})""",
    "score_ordered": f"""
SELECT record_no, valid AS valid_structure, valid AND CASE WHEN edit = 1 THEN called = list_reverse(called) ELSE names END AS correct_function_name,
       valid AND CASE WHEN edit = 1 THEN arg_keys = list_reverse(arg_keys) ELSE keys END AS correct_argument_names, valid AND CASE WHEN edit = 1 THEN args = list_reverse(args) ELSE vals END AS correct_argument_values,
       valid AND CASE WHEN edit = 1 THEN args = list_reverse(args) AND called = list_reverse(called) ELSE whole END AS complete_call_match, predicted::INT AS predicted_count, n::INT AS expected_count,
       (CASE WHEN NOT valid OR edit = 6 THEN 0 WHEN edit = 1 THEN len(list_filter(range(1, n + 1), lambda i: called[i] = called[n + 1 - i] AND args[i] = args[n + 1 - i])) WHEN whole THEN n ELSE n - 1 END)::INT AS matched FROM ({_SCORED})""",
    "score_single": f"""
SELECT record_no, one AND valid AS valid_structure, one AND (names OR edit = 5) AS correct_function_name, one AND keys AS correct_argument_names, one AND vals AS correct_argument_values, one AND whole AS complete_call_match,
       predicted::INT AS predicted_count, n::INT AS expected_count, (one AND whole)::INT AS matched FROM (SELECT *, n = 1 AND predicted = 1 AS one FROM ({_SCORED}))""",
    "score_accuracy": f"""
SELECT split, count(*) AS n, avg(valid::INT) AS valid_structure, avg((valid AND names)::INT) AS correct_function_name, avg((valid AND keys)::INT) AS correct_argument_names,
       avg((valid AND vals)::INT) AS correct_argument_values, avg((valid AND whole)::INT) AS complete_call_match FROM ({_SCORED}) WHERE split IS NOT NULL GROUP BY split""",
    "same_call_sets": f"SELECT record_no, CASE WHEN n = 0 THEN edit <> 7 ELSE whole END AS same FROM ({_SCORED})",
}
SQL |= chat_oracles.SQL
