"""DuckDB SQL that renders the canonical records as chats and derives blocks, spans and tokens from the text.

It builds the text from messages and tools with string functions only, so it shares nothing with the
renderer: JSON is spaced by a tokenising pattern, offsets are running sums of lengths.
"""

from __future__ import annotations

_BLANKS = r"\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
_TOKENS = rf"<\|im_start\|>|<\|im_end\|>|</?[a-z_]+>|[\p{{L}}\p{{N}}_]+|[{_BLANKS}]+|[^\p{{L}}\p{{N}}_{_BLANKS}]"


def _spaced(json: str) -> str:
    """SQL: JSON text with one blank behind each comma and colon outside strings."""
    parts = rf"""regexp_extract_all({json}, '"(?:[^"\\]|\\.)*"|[,:]|[^",:]+')"""
    return rf"""array_to_string(list_transform({parts}, lambda x: CASE WHEN x IN (',', ':') THEN x || ' ' WHEN x[1] = '"' THEN x ELSE regexp_replace(x, '\s', '', 'g') END), '')"""


_FUNCTION = """'{' || concat_ws(',', '"name":' || to_json(%s.name)::VARCHAR, %s) || '}'"""
_TOOL = """'{"type":' || coalesce(to_json(t.type)::VARCHAR, 'null') || ',"function":' || """ + _FUNCTION % (
    "t['function']",
    """'"description":' || to_json(t['function'].description)::VARCHAR, '"parameters":' || t['function'].parameters""",
) + " || '}'"
_CALL = _FUNCTION % ("c['function']", """'"arguments":' || c['function'].arguments""")

CHAT = rf"""
m AS (SELECT record_no, tools, coalesce(messages, []) AS messages FROM canonical_records),
head AS (
  SELECT record_no, array_to_string(list_concat(
           list_transform(list_filter(messages, lambda x: x.role = 'system'), lambda x: coalesce(x.content, '')),
           CASE WHEN len(tools) > 0 THEN ['# Tools' || chr(10) || '<tools>' || chr(10) || array_to_string(list_transform(tools, lambda t: {_spaced(_TOOL)}), chr(10)) || chr(10) || '</tools>'] ELSE [] END), chr(10) || chr(10)) AS body,
         len(tools) > 0 OR len(list_filter(messages, lambda x: x.role = 'system')) > 0 AS there
  FROM m),
turns AS (SELECT record_no, unnest(messages) AS t, generate_subscripts(messages, 1) AS pos FROM m),
texts AS (
  SELECT record_no, pos, t.role AS role, coalesce(t.content, '') AS content,
         array_to_string(list_transform(coalesce(t.tool_calls, []), lambda c: '<tool_call>' || chr(10) || {_spaced(_CALL)} || chr(10) || '</tool_call>'), chr(10)) AS calls FROM turns WHERE t.role <> 'system'),
parts AS (
  SELECT record_no, 0 AS pos, 'system' AS role, body, '' AS content, '' AS calls FROM head WHERE there
  UNION ALL
  SELECT record_no, pos, CASE WHEN role = 'tool' THEN 'user' ELSE role END, CASE WHEN role = 'tool' THEN '<tool_response>' || chr(10) || content || chr(10) || '</tool_response>'
         ELSE content || CASE WHEN content <> '' AND calls <> '' THEN chr(10) ELSE '' END || calls END, content, calls FROM texts),
b AS (
  SELECT *, '<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10) AS text, row_number() OVER w - 1 AS block_pos,
         coalesce(sum(length('<|im_start|>' || role || chr(10) || body || '<|im_end|>' || chr(10))) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM parts WINDOW w AS (PARTITION BY record_no ORDER BY pos)),
blocks AS (SELECT *, start + length('<|im_start|>' || role) + 1 AS content_start, start + length(text) - length('<|im_end|>') - 1 AS content_end, start + length(text) AS stop FROM b),
rendered AS (SELECT record_no, string_agg(text, '' ORDER BY block_pos) AS text, sum(CASE WHEN role = 'assistant' THEN len(regexp_extract_all(calls, '{_TOKENS}')) ELSE 0 END) AS included FROM blocks GROUP BY record_no),
spans AS (
  SELECT record_no, start, stop, 'user_request' AS region FROM blocks WHERE role NOT IN ('system', 'assistant') AND NOT (role = 'user' AND contains(body, '<tool_response>'))
  UNION ALL SELECT record_no, start, stop, 'tool_execution_result' FROM blocks WHERE role = 'user' AND contains(body, '<tool_response>')
  UNION ALL SELECT record_no, start, stop, 'system_prompt' FROM blocks WHERE role = 'system' AND NOT (contains(body, '<tools>') AND contains(body, '</tools>'))
  UNION ALL SELECT record_no, start, content_start + strpos(body, '<tools>') - 1, 'system_prompt' FROM blocks WHERE role = 'system' AND contains(body, '<tools>')
  UNION ALL SELECT record_no, content_start + strpos(body, '<tools>') - 1, content_start + strpos(body, '</tools>') + 7, 'tool_definitions' FROM blocks WHERE role = 'system' AND contains(body, '<tools>')
  UNION ALL SELECT record_no, content_start + strpos(body, '</tools>') + 7, stop, 'system_prompt' FROM blocks WHERE role = 'system' AND contains(body, '<tools>')
  UNION ALL SELECT record_no, start, content_start, 'assistant_scaffolding' FROM blocks WHERE role = 'assistant'
  UNION ALL SELECT record_no, content_end, stop, 'assistant_scaffolding' FROM blocks WHERE role = 'assistant'
  UNION ALL SELECT record_no, content_start + length(regexp_extract(content, '^[{_BLANKS}]*')), content_start + length(regexp_replace(content, '[{_BLANKS}]+$', '')), 'assistant_final_answer' FROM blocks WHERE role = 'assistant' AND regexp_matches(content, '[^{_BLANKS}]')
  UNION ALL SELECT record_no, content_end - length(calls), content_end, 'assistant_tool_call' FROM blocks WHERE role = 'assistant' AND calls <> ''),
words AS (SELECT record_no, unnest(tokens) AS token, generate_subscripts(tokens, 1) - 1 AS token_pos FROM (SELECT record_no, regexp_extract_all(text, '{_TOKENS}') AS tokens FROM rendered)),
placed AS (SELECT *, coalesce(sum(length(token)) OVER (PARTITION BY record_no ORDER BY token_pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM words)"""

_TAGS = "['<tools>', '</tools>', '<|tools_start|>', '<|tools_end|>', '<tool_call>', '</tool_call>', '<|tool_call_start|>', '<|tool_call_end|>']"

SQL: dict[str, str] = {
    "render_chatml": f"WITH {CHAT} SELECT record_no, text AS rendered_text, len(regexp_extract_all(text, '{_TOKENS}'))::INT AS token_count, 0 AS failures FROM rendered",
    "chat_blocks": f"WITH {CHAT} SELECT record_no, block_pos::INT AS block_pos, role, start::INT AS start, content_start::INT AS content_start, content_end::INT AS content_end, stop::INT AS \"end\", NULL::VARCHAR AS error FROM blocks",
    "loss_spans": f"""WITH {CHAT}
SELECT record_no, (row_number() OVER (PARTITION BY record_no ORDER BY start, stop) - 1)::INT AS span_pos, start::INT AS start, stop::INT AS "end", region, region = 'assistant_tool_call' AS in_loss, NULL::VARCHAR AS error FROM spans WHERE start < stop""",
    "mask_counts": f"WITH {CHAT} SELECT record_no, included::BIGINT AS included, (len(regexp_extract_all(text, '{_TOKENS}')) - included)::BIGINT AS ignored FROM rendered",
    "token_labels": f"""WITH {CHAT}
SELECT p.record_no, p.token_pos::INT AS token_pos, p.token, (coalesce(s.region, '') = 'assistant_tool_call')::INT AS label, coalesce(s.region, 'unclassified') AS region,
       p.start::INT AS start, (p.start + length(p.token))::INT AS "end", NULL::VARCHAR AS error
FROM placed p LEFT JOIN spans s ON s.record_no = p.record_no AND s.start <= p.start AND p.start + length(p.token) <= s.stop""",
    "tagged_section": rf"""WITH {CHAT}
SELECT record_no, nullif(regexp_extract(text, '(?s)<tools>[{_BLANKS}]*(.*?)[{_BLANKS}]*</tools>', 1), '') AS tool_section, list_filter({_TAGS}, lambda t: contains(text, t)) AS delimiters, contains(text, '<think') AS has_thinking FROM rendered""",
}
