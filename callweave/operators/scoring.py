"""Parsing and scoring of model output at scale, and registration for SQL.

The functions take text columns; null output is like empty output. Complete matches as a set need no
Python where calls are canonical: `same_calls` compares sorted arrays.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions import calls as c
from callweave.functions import chat
from callweave.jsonx import canonical

_TEXTS = T.ArrayType(T.StringType())
PARSED = (
    T.StructType()
    .add("calls", T.ArrayType(T.StructType().add("name", T.StringType()).add("arguments", T.StringType())))
    .add("valid_structure", T.BooleanType())
    .add("errors", _TEXTS)
    .add("had_extra_prose", T.BooleanType())
)
SCORED = T.StructType([T.StructField(f, T.BooleanType()) for f in ("valid_structure", *c.FLAGS)])
SCORED = SCORED.add("predicted_count", T.IntegerType()).add("expected_count", T.IntegerType()).add("parse_errors", _TEXTS).add("matched", T.IntegerType())


def _text(value: object) -> str:
    return value if isinstance(value, str) else ""


def _plain(text: str | None) -> str | None:
    """Text that Arrow can hold: lone surrogates become question marks."""
    return text if text is None or text.isascii() else text.encode("utf-8", "replace").decode()


@F.pandas_udf(PARSED)
def parse_calls(text: pd.Series) -> pd.DataFrame:
    """Calls found in model output, arguments as canonical JSON."""
    rows = [c.parse_calls(_text(t)) for t in text]
    return pd.DataFrame(
        {
            "calls": [[{"name": _plain(x.name), "arguments": None if x.arguments is None else _plain(canonical(x.arguments))} for x in r.calls] for r in rows],
            "valid_structure": [r.valid_structure for r in rows],
            "errors": [list(r.errors) for r in rows],
            "had_extra_prose": [r.had_extra_prose for r in rows],
        }
    )


def _scores(predicted: pd.Series, expected: pd.Series, ordered: bool) -> pd.DataFrame:
    rows = []
    for p, e in zip(predicted, expected):
        s = c.score_calls(_text(p), _text(e), ordered)
        flags = {f: getattr(s, f) for f in ("valid_structure", *c.FLAGS)}
        rows.append({**flags, "predicted_count": s.predicted_count, "expected_count": s.expected_count, "parse_errors": list(s.parse_errors), "matched": sum(x.complete_call_match for x in s.call_scores)})
    return pd.DataFrame(rows, columns=SCORED.names)


@F.pandas_udf(SCORED)
def score_calls(predicted: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Predicted against expected calls as sets."""
    return _scores(predicted, expected, False)


@F.pandas_udf(SCORED)
def score_calls_ordered(predicted: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Predicted against expected calls in order."""
    return _scores(predicted, expected, True)


@F.pandas_udf(SCORED)
def score_call(predicted: pd.Series, expected: pd.Series) -> pd.DataFrame:
    """Exactly one call against exactly one."""
    rows = []
    for p, e in zip(predicted, expected):
        a, b = c.parse_calls(_text(p)), c.parse_calls(_text(e))
        s = c.score_call(a, b)
        rows.append({**{f: getattr(s, f) for f in ("valid_structure", *c.FLAGS)}, "predicted_count": len(a.calls), "expected_count": len(b.calls), "parse_errors": list(s.parse_errors), "matched": int(s.complete_call_match)})
    return pd.DataFrame(rows, columns=SCORED.names)


def same_calls(predicted: Column, expected: Column) -> Column:
    """Complete match as a set of canonical call texts, without Python."""
    return F.array_sort(predicted) == F.array_sort(expected)


def accuracy(scored: DataFrame, score: str, *by: str) -> DataFrame:
    """Shares of records for which each flag holds."""
    s = F.col(score)
    flags = ("valid_structure", *c.FLAGS)
    return scored.groupBy(*by).agg(F.count("*").alias("n"), *(F.avg(s[f].cast("double")).alias(f) for f in flags))


class ParsedCalls:
    """Table function: one row for each call in a text."""

    def eval(self, text: str) -> Iterator[tuple]:
        for i, x in enumerate(c.parse_calls(_text(text)).calls):
            yield i, _plain(x.name), None if x.arguments is None else _plain(canonical(x.arguments))


class LossSpans:
    """Table function: one row for each span of a rendered text; malformed text gives one row with its error."""

    def eval(self, text: str) -> Iterator[tuple]:
        try:
            for a, b, region in chat.loss_spans(_text(text)):
                yield a, b, region, region == chat.TRAINED, None
        except ValueError as e:
            yield None, None, None, None, str(e)


def register(spark: SparkSession) -> None:
    """The functions under their names in SQL; parsed_calls and loss_spans for LATERAL."""
    for f in (parse_calls, score_call, score_calls, score_calls_ordered):
        spark.udf.register(f.__name__, f)
    spark.udtf.register("parsed_calls", F.udtf(ParsedCalls, returnType="call_pos int, name string, arguments string"))
    spark.udtf.register("loss_spans", F.udtf(LossSpans, returnType="start int, end int, region string, in_loss boolean, error string"))
