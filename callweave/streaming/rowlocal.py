"""The row-local stages on streams: they run unchanged, with duplicates dropped within a watermark.

Edge cases: rows that arrive later than the watermark are dropped by the engine as late; rows without
a time never pass the watermark; everything else is as in the batch stages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from callweave.operators.badrows import parse_lines
from callweave.operators.nested import shred
from callweave.operators.prepare import prepare


def prepared_stream(rows: DataFrame) -> DataFrame:
    """Raw rows of a stream through the preparation stage."""
    return prepare(rows)


def shredded_stream(rows: DataFrame) -> DataFrame:
    """Raw rows of a stream as flat node rows."""
    return shred(rows)


def loaded_stream(lines: DataFrame) -> DataFrame:
    """Lines of a stream with fields and reason."""
    return parse_lines(lines)


def distinct_stream(rows: DataFrame, key: list[str], time: str = "ingested_at", late: str = "8 days") -> DataFrame:
    """Rows delivered again within the watermark appear once."""
    return rows.withWatermark(time, late).dropDuplicatesWithinWatermark(key)


def arrivals(rows: DataFrame, time: str = "ingested_at", width: str = "1 day", late: str = "8 days") -> DataFrame:
    """Rows per window of arrival and source."""
    return rows.withWatermark(time, late).groupBy(F.window(time, width), "source_dataset").agg(F.count("*").alias("n"))
