"""Raw tool-calling rows to canonical records: decode, profile, gate, normalize and validate in one Arrow stage.

Each row crosses to Python once; what follows (gates, counts, joins) is relational. `depth` says how far a row
is worked on (PROFILE, RECORD, CHECKED), so that a fingerprint does not pay for records and checks; what lies
deeper is null. Columns named in `keep` pass through, so that nothing has to be joined back. Edge cases: any
failure of a row becomes its category and message, never an exception; null fields and ids that are
no whole number are 'invalid_source_id' or 'invalid_record'; input columns beyond row_index, id, query,
tools, answers (and the split column, if named) are ignored; repeated rows each get their own result.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import reduce
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.annotations import AnnotationError, annotated_default, compile_type
from callweave.functions.checks import CONTEXT_LIMIT, failure_issue, record_issues
from callweave.functions.records import GENERATOR_BOUNDARY, canonical_record, lists_of
from callweave.jsonx import canonical
from callweave.session import cut, hot_join, shared_table, spread
from callweave.sources import files

# --- fixed values: call buckets and terms of complex types ---------------------------------------
BUCKETS = ("single_call", "two_calls", "three_or_more_calls")
COMPLEX = ("array", "dict", "dictionary", "list", "object")
# --- end of fixed values -------------------------------------------------------------------------

#: How far a row is worked on.
PROFILE, RECORD, CHECKED = 1, 2, 3

SCHEMA = (
    "row_index long, id long, split string, gate string, error string, generator string, call_bucket string, available_tool_count int, "
    "expected_call_count int, distinct_expected_tool_count int, repeated_same_tool boolean, multiple_distinct_tools boolean, "
    "parameter_types array<string>, has_complex_parameters boolean, unknown_answer_tools array<string>, available_tool_names array<string>, "
    "expected_tool_names array<string>, argument_keys array<array<string>>, type_occurrences array<string>, fingerprint string, record string, "
    "issues array<struct<category: string, message: string>>, estimated_tokens int"
)
_STRINGS = pa.list_(pa.string())
_KINDS = {
    "long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": _STRINGS, "array<array<string>>": pa.list_(_STRINGS),
    "array<struct<category: string, message: string>>": pa.list_(pa.struct([("category", pa.string()), ("message", pa.string())])),
}
FIELDS = [tuple(part.split(" ", 1)) for part in SCHEMA.replace(", message", "; message").split(", ")]
_ARROW = pa.schema([(n, _KINDS[k.replace("; message", ", message")]) for n, k in FIELDS])


def bucket(calls: int) -> str:
    return BUCKETS[min(calls, 3) - 1] if calls > 0 else "zero_calls"


def _named(items: list[Any]) -> list[str]:
    return [str(x["name"]) for x in items if isinstance(x, dict) and x.get("name") is not None]


def profile(row_id: int, query: str, tools: list, answers: list, boundary: int = GENERATOR_BOUNDARY) -> dict[str, Any]:
    """What selection looks at, from the decoded lists as they are."""
    available, expected = set(_named(tools)), _named(answers)
    maps = [t.get("parameters", {}) for t in tools if isinstance(t, dict)]
    specs = [s for m in maps if isinstance(m, dict) for s in m.values() if isinstance(s, dict)]
    types = sorted({str(s["type"]) for s in specs if s.get("type") is not None})
    distinct = len(set(expected))
    arguments = [a.get("arguments", {}) if isinstance(a, dict) else {} for a in answers]
    text = canonical({"query": " ".join(query.lower().split()), "tools": tools})
    return {
        "id": row_id, "generator": "deepseek" if row_id < boundary else "mixtral", "call_bucket": bucket(len(answers)), "available_tool_count": len(tools),
        "expected_call_count": len(answers), "distinct_expected_tool_count": distinct, "repeated_same_tool": len(answers) > 1 and distinct == 1,
        "multiple_distinct_tools": distinct > 1, "parameter_types": types, "has_complex_parameters": any(c in t.lower() for t in types for c in COMPLEX),
        "unknown_answer_tools": sorted(set(expected) - available), "available_tool_names": sorted(available), "expected_tool_names": expected,
        "argument_keys": [sorted(a) if isinstance(a, dict) else [] for a in arguments], "type_occurrences": [str(s.get("type", "<missing>")) for s in specs],
        "fingerprint": hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest(),
    }


#: (category, the texts that a message must hold all of), the first that applies; fixed values.
REJECTIONS = (
    ("duplicate_tool_names", ("duplicate tool names",)),
    ("unsupported_callable_parameters", ("'callable'", "unsupported", "parameter type")),
    ("invalid_parameter_type_expressions", ("invalid parameter type expression",)),
    ("unavailable_answer_tools", ("references unavailable tool",)),
    ("unsupported_parameter_types", ("unsupported parameter type",)),
    ("unsupported_parameter_types", ("unsupported generic parameter type",)),
    ("unsupported_parameter_types", ("unsupported type constant",)),
    ("unsupported_parameter_types", ("unsupported type expression",)),
)


def rejection(message: str) -> str:
    """The rejection category of a failure to build the canonical record."""
    low = message.lower()
    return "normalization_" + next((name for name, texts in REJECTIONS if all(t in low for t in texts)), "other_errors")


def rejection_column(message: Column) -> Column:
    """`rejection` as an expression."""
    low, out = F.lower(message), F.lit("normalization_other_errors")
    for name, texts in reversed(REJECTIONS):
        holds = F.lit(True)
        for t in texts:
            holds &= F.contains(low, F.lit(t))
        out = F.when(holds, f"normalization_{name}").otherwise(out)
    return out


def prepare_row(row: dict[str, Any], split: str | None, limit: int, boundary: int, source: str, depth: int = CHECKED) -> dict[str, Any]:
    """All results for one row down to `depth`; `gate` is null for an eligible row (duplicates of an id aside)."""
    try:
        int(row["id"])
    except (TypeError, ValueError):
        return {"gate": "invalid_source_id"}
    try:
        parts = lists_of(row)
    except AnnotationError as e:
        category, message = failure_issue(str(e))
        return {"id": int(row["id"]), "gate": "invalid_record", "error": str(e), "issues": [{"category": category, "message": message}]}
    out = profile(*parts, boundary)
    if depth < RECORD:
        return out
    try:
        record = canonical_record(row, split or "selection", source, boundary=boundary)
    except AnnotationError as e:
        category, message = failure_issue(str(e))
        return {**out, "gate": rejection(str(e)), "error": str(e), "issues": [{"category": category, "message": message}]}
    out["record"] = canonical(record)
    if depth < CHECKED:
        return out
    issues, tokens = record_issues(record, limit)
    return {**out, "issues": [{"category": c, "message": m} for c, m in issues], "estimated_tokens": tokens}


def _plain(value: Any) -> Any:
    """Text that Arrow can hold: lone surrogates become question marks."""
    if isinstance(value, str):
        return value if value.isascii() else value.encode("utf-8", "replace").decode()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    return {k: _plain(v) for k, v in value.items()} if isinstance(value, dict) else value


def _stage(limit: int, boundary: int, source: str, depth: int, keep: int):  # noqa: ANN202
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            columns = [c.to_pylist() for c in batch.columns[:6]]
            for row_index, id_, query, tools, answers, split in zip(*columns):
                own = {"id": id_, "query": query, "tools": tools, "answers": answers}
                out.append(_plain({"row_index": row_index, "split": split, **prepare_row(own, split, limit, boundary, source, depth)}))
            done = pa.RecordBatch.from_pylist(out, schema=_ARROW)
            yield pa.RecordBatch.from_arrays([*done.columns, *batch.columns[6:]], names=[*done.schema.names, *batch.schema.names[6:]]) if keep else done

    return run


def prepare(
    rows: DataFrame, split: str | None = None, limit: int = CONTEXT_LIMIT, boundary: int = GENERATOR_BOUNDARY, source: str = "fc", depth: int = CHECKED, keep: tuple[str, ...] = ()
) -> DataFrame:
    """The stage over raw rows. `split` names a column with the split of each row (else 'selection')."""
    if clash := {n for n, _ in FIELDS} & set(keep):
        raise ValueError(f"columns of the stage cannot be kept: {sorted(clash)}")
    text = [F.col(c).cast("string").alias(c) for c in ("query", "tools", "answers")]
    mark = F.col(split).cast("string") if split else F.lit(None).cast("string")
    slim = rows.select(F.col("row_index").cast("long").alias("row_index"), F.col("id").cast("long").alias("id"), *text, mark.alias("split"), *keep)
    schema = ", ".join([SCHEMA, *(f"`{f.name}` {f.dataType.simpleString()}" for f in slim.schema.fields[6:])])
    return spread(slim).mapInArrow(_stage(limit, boundary, source, depth, len(keep)), schema)


def inspect_row(query: Any, tools: Any, answers: Any) -> dict[str, Any]:
    """What an inspection counts of a row: its first fault, or its counts, tool namespaces and parameter types."""
    if not isinstance(query, str):
        return {"fault": "query_not_string"}
    if not query.strip():
        return {"fault": "query_empty"}
    lists = {}
    for field, value in (("tools", tools), ("answers", answers)):
        try:
            lists[field] = json.loads(value) if isinstance(value, str) else value
        except (ValueError, RecursionError):
            return {"fault": f"{field}_invalid_json"}
    for field, value in lists.items():
        if not isinstance(value, list):
            return {"fault": f"{field}_not_list"}
    objects = [t for t in lists["tools"] if isinstance(t, dict)]
    names = [t["name"] for t in objects if isinstance(t.get("name"), str) and t["name"]]
    specs = [s for t in objects if isinstance(t.get("parameters", {}), dict) for s in t.get("parameters", {}).values() if isinstance(s, dict)]
    return {
        "tool_count": len(lists["tools"]), "call_count": len(lists["answers"]), "tool_not_object": len(lists["tools"]) - len(objects),
        "namespaces": [n.split(".", 1)[0] for n in names], "types": [str(s.get("type", "<missing>")) for s in specs],
    }


_INSPECTED = {"fault": pa.string(), "tool_count": pa.int32(), "call_count": pa.int32(), "tool_not_object": pa.int32(), "namespaces": _STRINGS, "types": _STRINGS}


def inspection_profile(rows: DataFrame) -> DataFrame:
    """(measure, value, n) over raw rows: rows by fault or parsed, tools that are no objects, distributions of counts, namespaces and types.

    Types are counted as often as they stand, and only of rows that parse.
    """
    schema = pa.schema(list(_INSPECTED.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_plain(inspect_row(*r)) for r in zip(*(c.to_pylist() for c in batch.columns))], schema=schema)

    text = [F.col(c).cast("string").alias(c) for c in ("query", "tools", "answers")]
    seen = spread(rows.select(*text)).mapInArrow(run, "fault string, tool_count int, call_count int, tool_not_object int, namespaces array<string>, types array<string>")
    one = lambda measure, value: F.array(F.struct(F.lit(measure).alias("measure"), value.cast("string").alias("value"), F.lit(1).cast("long").alias("n")))
    many = lambda measure, column: F.transform(F.coalesce(column, F.array().cast("array<string>")), lambda x: F.struct(F.lit(measure).alias("measure"), x.alias("value"), F.lit(1).cast("long").alias("n")))
    odd = F.array(F.struct(F.lit("fault").alias("measure"), F.lit("tool_not_object").alias("value"), F.col("tool_not_object").cast("long").alias("n")))
    parts = F.concat(one("fault", F.coalesce("fault", F.lit("none"))), odd, one("tools", F.col("tool_count")), one("calls", F.col("call_count")), many("namespace", F.col("namespaces")), many("parameter_type", F.col("types")))
    return seen.select(F.inline(parts)).where("value is not null and n > 0").groupBy("measure", "value").agg(F.sum("n").alias("n"))


def gated(prepared: DataFrame) -> DataFrame:
    """The final gate of each row: an id is taken by its first eligible row, later readable rows are duplicates.

    The first eligible row of an id comes from an aggregation, so an id with very many rows is no hot task.
    The rows are written once in the shared folder, as both sides of the join need them; callers
    select the columns they want before.
    """
    prepared = shared_table(prepared)
    keys = prepared.groupBy("id").agg(F.min(F.when(F.col("gate").isNull(), F.col("row_index"))).alias("first"), F.count("*").alias("rows_of_id"))
    late = F.col("id").isNotNull() & (F.col("row_index") > F.col("first")) & ~F.coalesce(F.col("gate").isin("invalid_source_id", "invalid_record"), F.lit(False))
    marked = hot_join(prepared, cut(keys.where("first is not null")), "id", "rows_of_id", "left")
    return marked.withColumn("gate", F.when(late, "duplicate_id").otherwise(F.col("gate"))).drop("first", "rows_of_id")


CANDIDATE = [
    "row_index", "id", "generator", "call_bucket", "available_tool_count", "expected_call_count", "distinct_expected_tool_count", "repeated_same_tool",
    "multiple_distinct_tools", "parameter_types", "has_complex_parameters", "unknown_answer_tools", "fingerprint",
]


def candidates(prepared: DataFrame) -> DataFrame:
    """The eligible rows."""
    return gated(prepared.select("gate", *CANDIDATE)).where("gate is null").select(*CANDIDATE)


def rejections(prepared: DataFrame) -> DataFrame:
    """Rows per reason of rejection."""
    return gated(prepared.select("row_index", "id", "gate")).where("gate is not null").groupBy("gate").agg(F.count("*").alias("n"))


def issue_counts(prepared: DataFrame) -> DataFrame:
    """Rows per issue category, each row once per category."""
    each = prepared.select(F.explode(F.array_distinct(F.transform("issues", lambda x: x["category"]))).alias("category"))
    return each.groupBy("category").agg(F.count("*").alias("n"))


def load_records(spark: SparkSession, normalized: str, raw: str, splits: tuple[str, ...] = ("train", "validation", "test")) -> tuple[str, DataFrame]:
    """("normalized" or "raw", records) of a selection in files: the normalized split files if all are there, else the raw ones normalized on the way.

    Records come as (split, source_id, id, record) in the order of split, source_id and id; a raw row that
    cannot be normalized raises ValueError; without either set of files FileNotFoundError is raised.
    """
    there = {name: all(files.exists(spark, f"{folder}/{s}.jsonl") for s in splits) for name, folder in (("normalized", normalized), ("raw", raw))}
    if there["normalized"]:
        source, parts = "normalized", [spark.read.text(f"{normalized}/{s}.jsonl").where(F.trim("value") != "").select(F.lit(s).alias("split"), F.col("value").alias("record")) for s in splits]
        rows = reduce(DataFrame.unionByName, parts)
    elif there["raw"]:
        source, read = "raw", files.read_splits(spark, raw, files.RAW, splits)
        done = cut(prepare(read.withColumn("row_index", F.monotonically_increasing_id()), split="split", depth=RECORD).select("split", "record", "error"))
        if failed := done.where("error is not null or record is null").select("error").limit(5).collect():
            raise ValueError(f"rows that cannot be normalized: {[r.error for r in failed]}")
        rows = done.select("split", "record")
    else:
        raise FileNotFoundError(f"neither {normalized} nor {raw} has all of {splits}")
    rank = F.array_position(F.array(*map(F.lit, splits)), F.col("split"))
    rows = rows.select("split", F.get_json_object("record", "$.metadata.source_id").cast("long").alias("source_id"), F.get_json_object("record", "$.id").alias("id"), "record")
    return source, rows.orderBy(rank, "source_id", "id")


_TYPE_SCHEMA = "type string, schema string, json_type string, optional boolean, default_value string, error string"


def _compile(raw: str) -> dict[str, Any]:
    try:
        schema, optional = compile_type(raw)
        given, value = annotated_default(raw)
    except AnnotationError as e:
        return {"error": str(e)}
    top = schema.get("type") if isinstance(schema.get("type"), str) else None
    try:
        text = canonical(value) if given else None
    except TypeError:  # a default that JSON has no form for
        text = repr(value)
    return {"schema": canonical(schema), "json_type": top, "optional": optional, "default_value": text}


def type_schemas(types: DataFrame) -> DataFrame:
    """JSON Schema, optional mark and default of each distinct annotation in `types` (column type)."""
    names = [p.split()[0] for p in _TYPE_SCHEMA.split(", ")]
    schema = pa.schema([(n, pa.bool_() if n == "optional" else pa.string()) for n in names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_pylist([_plain({"type": t, **_compile(t)}) for t in batch.column(0).to_pylist()], schema=schema)

    return types.select("type").where("type is not null").distinct().mapInArrow(run, _TYPE_SCHEMA)


def typed_parameters(parameters: DataFrame) -> DataFrame:
    """Parameters with the schema of their annotation: each distinct annotation is compiled once."""
    return parameters.join(type_schemas(parameters), "type", "left")

