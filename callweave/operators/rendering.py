"""Rendered chats at scale: template checks, chat blocks, loss-mask spans, token labels.

A tokenizer is given as a factory, called once a Python worker. Edge cases: a record that cannot be
rendered or whose text is malformed gives one row with its error; null messages or tools count as
empty; arguments that are JSON text are decoded, others stay text. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import partial
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.functions import chat
from callweave.functions.checks import estimated_tokens
from callweave.jsonx import BAD, canonical, try_loads
from callweave.operators import quality
from callweave.session import spread

Factory = Callable[[], Any]
CHECKS = [*chat.FAILURES, "decoded_matches_rendered"]

RENDERED = "record_no long, token_count int, rendered_text string, decoded_text string, tool_section_tags array<string>, tool_call_delimiters array<string>, thinking_mode_requested boolean, thinking_mode_supported boolean, expected_calls string, rendered_calls string, " + ", ".join(f"{c} boolean" for c in CHECKS) + ", failures array<string>, error string"
SPANS = "record_no long, span_pos int, start int, end int, region string, in_loss boolean, error string"
LABELS = "record_no long, token_pos int, token_id int, token string, label int, region string, start int, end int, error string"
DIAGNOSTIC = "record_no long, lines string, error string"
BLOCKS = "record_no long, block_pos int, role string, start int, content_start int, content_end int, end int, error string"
_KINDS = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "boolean": pa.bool_(), "array<string>": pa.list_(pa.string())}


def _schema(ddl: str) -> pa.Schema:
    return pa.schema([(n, _KINDS[k]) for n, k in (p.split(" ") for p in ddl.split(", "))])


def plain_record(messages: list | None, tools: list | None) -> dict[str, Any]:
    """Typed messages and tools as the plain record that templates take."""

    def decoded(text: str | None) -> Any:
        value = try_loads(text)
        return text if value is BAD else value

    def body(x: dict, field: str) -> dict:
        f = x.get("function") or {}
        return {**x, "function": {k: decoded(v) if k == field else v for k, v in f.items() if v is not None}}

    out = []
    for m in messages or []:
        turn = {"role": m.get("role") or "", "content": m.get("content") or ""}
        if m.get("tool_calls"):
            turn["tool_calls"] = [body(c, "arguments") for c in m["tool_calls"] if c]
        out.append(turn)
    return {"messages": out, "tools": [body(t, "parameters") for t in tools or [] if t]}


def _rendered(record_no: int, record: dict, tokenizer: Any, enable_thinking: bool = False) -> Iterator[dict]:
    x = chat.render_checked(record, tokenizer, enable_thinking)
    yield {
        **{k: x[k] for k in ("token_count", "rendered_text", "decoded_text", "tool_call_delimiters", "thinking_mode_requested", "thinking_mode_supported", "tool_section_tags")}, "record_no": record_no,
        "expected_calls": canonical(x["expected_calls"]), "rendered_calls": canonical(x["rendered_calls"]), "failures": x["failures"], **x["checks"],
    }


def _spans(record_no: int, record: dict, tokenizer: Any) -> Iterator[dict]:
    text = tokenizer.apply_chat_template(record["messages"], tools=record["tools"], tokenize=False)
    for i, (a, b, region) in enumerate(chat.loss_spans(text)):
        yield {"record_no": record_no, "span_pos": i, "start": a, "end": b, "region": region, "in_loss": region == chat.TRAINED}


def _blocks(record_no: int, record: dict, tokenizer: Any) -> Iterator[dict]:
    text = tokenizer.apply_chat_template(record["messages"], tools=record["tools"], tokenize=False)
    for i, b in enumerate(chat.blocks(text)):
        yield {"record_no": record_no, "block_pos": i, "role": b.role, "start": b.start, "content_start": b.content, "content_end": b.content_end, "end": b.end}


def _labels(record_no: int, record: dict, tokenizer: Any, enable_thinking: bool = False, pad_to: int | None = None) -> Iterator[dict]:
    for i, token, text, label, region, a, b in chat.token_labels(record, tokenizer, enable_thinking, pad_to):
        yield {"record_no": record_no, "token_pos": i, "token_id": token, "token": text, "label": label, "region": region, "start": a, "end": b}


def _diagnostic(record_no: int, record: dict, tokenizer: Any) -> Iterator[dict]:
    yield {"record_no": record_no, "lines": chat.diagnostic(chat.token_labels(record, tokenizer), 120, True)}


def _per_record(records: DataFrame, ddl: str, work: Callable[[int, dict, Any], Iterator[dict]], factory: Factory) -> DataFrame:
    schema = _schema(ddl)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = factory()
        for batch in batches:
            out: list[dict] = []
            for row in batch.to_pylist():
                try:
                    out += work(row["record_no"], plain_record(row["messages"], row["tools"]), tokenizer)
                except (ValueError, TypeError, IndexError, KeyError, RecursionError) as e:
                    out.append({"record_no": row["record_no"], "error": f"{type(e).__name__}: {e}"})
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_pylist(out, schema=schema)
                    out = []
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return spread(records.select("record_no", "messages", "tools")).mapInArrow(run, ddl)


def template_checks(records: DataFrame, tokenizer: Factory = chat.ChatMarkup, enable_thinking: bool = False) -> DataFrame:
    """Rendered text, round-tripped calls and the nine checks of each record."""
    return _per_record(records, RENDERED, partial(_rendered, enable_thinking=enable_thinking), tokenizer)


def rendered_reports(records: DataFrame, tokenizer: Factory = chat.ChatMarkup, enable_thinking: bool = False) -> DataFrame:
    """record_no and `report`: what was rendered of each record, its features and checks as one JSON document."""
    flags = quality.feature_flags(records)
    about = flags.select("record_no", "id", "split", "source_id", "available_tool_count", "expected_call_count").join(quality.feature_tags(flags).withColumnRenamed("tags", "feature_tags"), "record_no")
    x = template_checks(records, tokenizer, enable_thinking).join(about, "record_no")
    calls = {c: F.from_json(c, "array<struct<name: string, arguments: string>>").alias(c) for c in ("expected_calls", "rendered_calls")}
    top = ["id", "split", "source_id", "feature_tags", "available_tool_count", "expected_call_count", "token_count", "thinking_mode_requested", "thinking_mode_supported", "tool_section_tags", "tool_call_delimiters"]
    report = F.struct(*top, *calls.values(), F.struct(*CHECKS, "failures").alias("checks"), "rendered_text", "decoded_text")
    return x.select("record_no", F.to_json(report, {"ignoreNullFields": "false"}).alias("report"), "error", F.size("failures").alias("failed"))


def chat_blocks(records: DataFrame, tokenizer: Factory = chat.ChatMarkup) -> DataFrame:
    return _per_record(records, BLOCKS, _blocks, tokenizer)


def loss_spans(records: DataFrame, tokenizer: Factory = chat.ChatMarkup) -> DataFrame:
    return _per_record(records, SPANS, _spans, tokenizer)


def token_labels(records: DataFrame, tokenizer: Factory = chat.ChatMarkup, enable_thinking: bool = False, pad_to: int | None = None) -> DataFrame:
    """The token table of each record; ids of the default tokenizer are local to a worker."""
    return _per_record(records, LABELS, partial(_labels, enable_thinking=enable_thinking, pad_to=pad_to), tokenizer)


def mask_diagnostics(records: DataFrame, tokenizer: Factory = chat.ChatMarkup) -> DataFrame:
    """Up to 120 tokens and labels of each record as text, from shortly before the first trained token."""
    return _per_record(records, DIAGNOSTIC, _diagnostic, tokenizer)


def estimated_lengths(records: DataFrame) -> DataFrame:
    """record_no and estimated tokens of the rendered record: a quarter of the length of its canonical JSON, 1 at least."""
    work = lambda record_no, record, _: iter([{"record_no": record_no, "tokens": estimated_tokens(record)}])
    return _per_record(records, "record_no long, tokens int, error string", work, lambda: None)


def mask_counts(labels: DataFrame) -> DataFrame:
    """Tokens in and out of the loss per record."""
    return labels.where("error is null").groupBy("record_no").agg(F.count_if(F.col("label") != chat.IGNORE).alias("included"), F.count_if(F.col("label") == chat.IGNORE).alias("ignored"))


def sections(texts: DataFrame, column: str = "rendered_text") -> DataFrame:
    """Native expressions over rendered text: longest tool section, delimiters in order, thinking."""
    text = F.col(column)
    both = F.lit(r"(?s)<tools>(.*?)</tools>"), F.lit(r"(?s)<\|tools_start\|>(.*?)<\|tools_end\|>")
    found = F.transform(F.concat(*(F.regexp_extract_all(text, p, F.lit(1)) for p in both)), lambda s: F.regexp_replace(s, r"(?U)^\s+|\s+$", ""))
    longest = F.aggregate(found, F.lit(None).cast("string"), lambda a, x: F.when(a.isNull() | (F.length(x) > F.length(a)), x).otherwise(a))
    tags = [t for pair in chat.TOOL_SECTIONS + chat.CALL_TAGS for t in pair]
    marks = F.filter(F.array(*(F.lit(t) for t in tags)), lambda t: F.contains(text, t))
    thoughts = F.regexp_extract_all(text, F.lit(r"(?s)<think>(.*?)</think>"), F.lit(1))
    other = F.lit(False)
    for t in chat.THINKING:
        other |= F.contains(text, F.lit(t))
    thinking = F.when(F.size(thoughts) > 0, F.exists(thoughts, lambda s: s.rlike(r"(?U)\S"))).otherwise(other)
    return texts.withColumns({"tool_section": longest, "delimiters": marks, "has_thinking": thinking})
