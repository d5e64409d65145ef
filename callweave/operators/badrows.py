"""Rows that fail to parse (problem 6): valid rows load, bad rows come out with the reason.

Blocks of records take a columnar path: one RE2 pass for the record grammar, one CSV parse of the
joined block, one id check on the column and one JSON decode of the joined fields. If any check
fails the block is halved and both halves are tried again; a failing block of one record is a bad
record and is diagnosed strictly. A block only passes if each of its records is valid alone:
the grammar is checked per record, and in the joined JSON a random separator must come out at
every second top-level place, which no record can shift for another one.

Edge cases: a null line is 'column_count' (it has no fields), an empty line too (one field); `\\r`
outside quotes is ordinary text; duplicates are kept, each judged alone; an id may have spaces
around it and leading zeros; ids up to 9223372036854775807. Input columns other than line_id and
line are ignored.
"""

from __future__ import annotations

import io
import json
import re
import secrets
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.csv as pacsv
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.jsonx import is_json_deep, loads_strict
from callweave.session import spread

ROW_SCHEMA = "line_id long, reason string, id long, query string, tools string, answers string"
_ARROW_SCHEMA = pa.schema([("line_id", pa.int64()), ("reason", pa.string()), ("id", pa.int64()), ("query", pa.string()), ("tools", pa.string()), ("answers", pa.string())])
BLOCK = 64
MAX_ID = 9223372036854775807

_FIELD = r'(?:"(?:[^"]|"")*"|[^",][^,"]*|)'
_RECORD = rf"(?s)\A{_FIELD}(?:,{_FIELD}){{3}}\z"
_ID = re.compile(r" *([0-9]+) *")
_CSV = {
    "read_options": pacsv.ReadOptions(column_names=["id", "query", "tools", "answers"], block_size=1 << 30, use_threads=False),
    "parse_options": pacsv.ParseOptions(newlines_in_values=True, ignore_empty_lines=False),
    "convert_options": pacsv.ConvertOptions(column_types={c: pa.string() for c in ("id", "query", "tools", "answers")}, strings_can_be_null=False, check_utf8=False),
}


def _refuse(token: str) -> None:
    raise ValueError(token)


def _arrays_of_objects(texts: list[str]) -> bool:
    """True if each text alone is a standard JSON array of at least one object and nothing else."""
    mark = secrets.token_hex(12)
    values = json.loads("[" + f',"{mark}",'.join(texts) + "]", parse_constant=_refuse)
    n = len(texts)
    return len(values) == 2 * n - 1 and all(v == mark for v in values[1::2]) and all(isinstance(v, list) and v and all(isinstance(x, dict) for x in v) for v in values[::2])


def _bulk(lines: list[str]) -> list[tuple] | None:
    """The records of a block of well-formed records by the columnar path, or None if a value is not valid."""
    try:
        parsed = pacsv.read_csv(io.BytesIO("\n".join(lines).encode()), **_CSV)
        ids = pc.utf8_trim(parsed["id"], " ")
        if parsed.num_rows != len(lines) or not pc.all(pc.match_substring_regex(ids, r"\A[0-9]{1,18}\z")).as_py():
            return None
        tools, answers = parsed["tools"].to_pylist(), parsed["answers"].to_pylist()
        if not _arrays_of_objects(tools) or not _arrays_of_objects(answers):
            return None
        return list(zip(pc.cast(ids, pa.int64()).to_pylist(), parsed["query"].to_pylist(), tools, answers))
    except (ValueError, RecursionError, pa.ArrowInvalid):
        return None


def split_fields(line: str) -> list[str] | None:
    """The fields of one record, or None if its quoting is broken."""
    fields, pos, n = [], 0, len(line)
    while True:
        if pos < n and line[pos] == '"':
            parts, pos = [], pos + 1
            while True:
                end = line.find('"', pos)
                if end < 0:
                    return None
                parts.append(line[pos:end])
                pos = end + 1
                if pos < n and line[pos] == '"':
                    parts.append('"')
                    pos += 1
                else:
                    break
            if pos < n and line[pos] != ",":
                return None
            fields.append("".join(parts))
        else:
            end = line.find(",", pos)
            end = n if end < 0 else end
            if '"' in line[pos:end]:
                return None
            fields.append(line[pos:end])
            pos = end
        if pos >= n:
            return fields
        pos += 1


def _good_array(text: str) -> bool:
    try:
        value = loads_strict(text)
    except ValueError as e:
        return isinstance(e.__cause__, RecursionError) and is_json_deep(text)[1]
    return isinstance(value, list) and bool(value) and all(isinstance(x, dict) for x in value)


def diagnose(line: str | None) -> tuple:
    """(reason or None, id, query, tools, answers) of one record, by the strict rules in their order."""
    if line is None:
        return "column_count", None, None, None, None
    fields = split_fields(line)
    if fields is None:
        return "quoting", None, None, None, None
    if len(fields) != 4:
        return "column_count", None, None, None, None
    m = _ID.fullmatch(fields[0])
    if not m or int(m[1]) > MAX_ID:
        return "id", None, *fields[1:]
    for name, text in (("tools", fields[2]), ("answers", fields[3])):
        if not _good_array(text):
            return name, int(m[1]), *fields[1:]
    return None, int(m[1]), *fields[1:]


def well_formed(lines: list[str | None]) -> list[bool]:
    """Which lines are records of four fields by the grammar, in one columnar pass."""
    column = pa.array(lines, pa.string())
    good = pc.and_(pc.match_substring_regex(column, _RECORD), pc.invert(pc.match_substring(column, "\r")))
    return pc.fill_null(good, False).to_pylist()


def parse_block(lines: list[str | None], formed: list[bool] | None = None) -> list[tuple]:
    """Results of a block in order: bulk where it is clean, bisected down to single records where it is not."""
    formed = well_formed(lines) if formed is None else formed
    if all(formed) and (rows := _bulk(lines)) is not None:
        return [(None, *r) for r in rows]
    if len(lines) == 1:
        return [diagnose(lines[0])]
    half = len(lines) // 2
    return parse_block(lines[:half], formed[:half]) + parse_block(lines[half:], formed[half:])


def _parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for start in range(0, batch.num_rows, BLOCK):
            part = batch.slice(start, BLOCK)
            columns = list(zip(*parse_block(part.column(1).to_pylist())))
            yield pa.RecordBatch.from_arrays([part.column(0), *(pa.array(c, f.type) for c, f in zip(columns, list(_ARROW_SCHEMA)[1:]))], schema=_ARROW_SCHEMA)


def parse_lines(df: DataFrame) -> DataFrame:
    """Each line (line_id, line) with its fields and the reason it cannot be read (null: it can)."""
    return spread(df.select(F.col("line_id").cast("long"), F.col("line").cast("string"))).mapInArrow(_parse, ROW_SCHEMA)


def good_rows(parsed: DataFrame) -> DataFrame:
    """The loaded records."""
    return parsed.where(F.col("reason").isNull()).drop("reason")


def bad_rows(parsed: DataFrame) -> DataFrame:
    """The lines that cannot be read, with the first reason."""
    return parsed.where(F.col("reason").isNotNull()).select("line_id", "reason")
