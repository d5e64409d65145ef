"""Checks over whole sets of records: splits, duplicates, features, profile counts.

Edge cases: null splits or ids take no part in the comparisons; repeated rows count as often as they
stand; empty tables give empty results (or zeros where a single row is reported).
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from callweave.functions.records import complex_parameters
from callweave.jsonx import try_loads
from callweave.session import cut, hot_join

SPLIT_RANK = {"train": 0, "validation": 1, "test": 2}


def split_rank(column: str = "split") -> Column:
    out = F.lit(len(SPLIT_RANK))
    for name, rank in SPLIT_RANK.items():
        out = F.when(F.col(column) == name, rank).otherwise(out)
    return out


def squeezed(text: Column) -> Column:
    """Lower case, runs of white space as one blank, none outside."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[\s\x1c-\x1f]+", " "))


def text_fingerprint(text: Column) -> Column:
    return F.sha2(squeezed(text), 256)


def namespace(name: Column) -> Column:
    """What stands before the first dot of a tool's name."""
    return F.substring_index(name, ".", 1)


def token_estimate(text: Column, per_token: int = 4) -> Column:
    return F.greatest(F.lit(1).cast("long"), F.ceil(F.length(text) / per_token))


def cross_split_duplicates(records: DataFrame) -> DataFrame:
    """Records whose fingerprint first stands in an earlier split; within one split nothing is reported.

    The owner of a fingerprint is an aggregate, so a fingerprint that very many records share is no hot task.
    """
    ranked = records.where("split is not null and fingerprint is not null").select("id", "split", "fingerprint", split_rank().alias("rank"))
    owner = ranked.groupBy("fingerprint").agg(F.min(F.struct("rank", "split")).alias("o"), F.max("rank").alias("last"), F.count("*").alias("n"))
    owner = cut(owner.where("last > o.rank").select("fingerprint", F.col("o.rank").alias("first"), F.col("o.split").alias("owner"), "n"))
    return hot_join(ranked, owner, "fingerprint").where(F.col("rank") > F.col("first")).select("id", "split", "owner", "fingerprint")


def duplicate_groups(rows: DataFrame, key: str) -> DataFrame:
    """Keys that stand in more than one row, with their count and lowest row."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("n"), F.min("row_index").alias("first_row")).where("n > 1")


def split_report(records: DataFrame) -> DataFrame:
    """Per split: rows, distinct ids, and ids that stand in another split too."""
    per = records.where("split is not null").groupBy("id", "split").agg(F.count("*").alias("n"))  # rows of one id are one row from here on
    marked = per.groupBy("id").agg(F.collect_list(F.struct("split", "n")).alias("splits")).select("id", (F.size("splits") > 1).alias("shared"), F.inline("splits"))
    known = F.col("id").isNotNull()
    return marked.groupBy("split").agg(F.sum("n").alias("n"), F.count_if(known).alias("ids"), F.count_if(known & F.col("shared")).alias("shared_ids"))


def verify_splits(records: DataFrame, expected: dict[str, int]) -> None:
    """Raise ValueError unless each split has its exact count, unique ids, and shares none."""
    found = {r.split: r for r in split_report(records).collect()}  # one row a split
    for split, n in expected.items():
        row = found.get(split)
        if row is None or row.n != n:
            raise ValueError(f"{split}: expected {n} records, found {row.n if row else 0}.")
        if row.ids != row.n:
            raise ValueError(f"{split}: ids are not unique.")
        if row.shared_ids:
            raise ValueError(f"{split}: {row.shared_ids} ids stand in other splits too.")


def verification_report(raw: DataFrame, normalized: DataFrame, expected: dict[str, int]) -> dict[str, object]:
    """The report of two split directories (split, id) that hold what is expected and the same ids; else ValueError."""
    for rows in (raw, normalized):
        verify_splits(rows, expected)
    if off := id_mismatches(raw, normalized).limit(5).collect():
        raise ValueError(f"Raw and normalized ids differ: {[(r.split, r.id) for r in off]}.")
    about = {"total_records": sum(expected.values()), "split_counts": dict(expected)}
    return {
        "verification_schema_version": "1.0", "expected_split_sizes": dict(expected), "raw": about, "normalized": about,
        "raw_and_normalized_ids_match": True, "total_examples": about["total_records"],
    }


def id_mismatches(left: DataFrame, right: DataFrame) -> DataFrame:
    """(split, id) pairs that only one side has, or more often: n_left and n_right."""
    n = lambda c, side: c.select("split", "id", F.lit(side).alias("side"))
    both = n(left, 0).unionByName(n(right, 1)).groupBy("split", "id")
    return both.agg(F.count_if(F.col("side") == 0).alias("n_left"), F.count_if(F.col("side") == 1).alias("n_right")).where("n_left <> n_right")


def call_names(messages: str = "messages") -> Column:
    """Names of all calls of a record with typed messages, in order."""
    per = F.transform(messages, lambda m: F.transform(F.coalesce(m["tool_calls"], F.array()), lambda c: c["function"]["name"]))
    return F.flatten(F.filter(per, lambda x: x.isNotNull()))


def expected_calls(records: DataFrame) -> DataFrame:
    """One row for each call of each record: record_no, call_pos, name, arguments."""
    per = F.flatten(F.transform(F.filter("messages", lambda m: m["tool_calls"].isNotNull()), lambda m: m["tool_calls"]))
    return records.select("record_no", F.posexplode(per).alias("call_pos", "c")).select("record_no", "call_pos", F.col("c.function.name").alias("name"), F.col("c.function.arguments").alias("arguments"))


@F.pandas_udf(T.BooleanType())
def nested_parameters(schemas: pd.Series) -> pd.Series:
    """Whether any of a record's parameter schemas (JSON texts) holds an array, an object or alternatives below the top."""

    def nested(texts: list[str] | None) -> bool:
        values = [try_loads(t) for t in (texts if texts is not None else [])]
        return complex_parameters({"tools": [{"function": {"parameters": v}} for v in values if isinstance(v, dict)]})

    return schemas.map(nested, na_action=None)


def feature_flags(records: DataFrame) -> DataFrame:
    """Counts and flags of canonical records (typed messages and tools)."""
    names = call_names()
    out = records.select("record_no", "id", "metadata", names.alias("names"), F.size("tools").alias("tool_count"), nested_parameters(F.transform("tools", lambda t: t["function"]["parameters"])).alias("complex_parameters"))
    return out.select(
        "record_no", "id", F.col("metadata.split").alias("split"), F.col("metadata.source_id").alias("source_id"), F.size("names").alias("expected_call_count"), F.col("tool_count").alias("available_tool_count"),
        (F.size(F.array_distinct("names")) >= 2).alias("multiple_called_tools"), (F.size("names") > F.size(F.array_distinct("names"))).alias("repeated_tool_calls"), "complex_parameters",
    )


def feature_tags(flags: DataFrame) -> DataFrame:
    """record_no and its tags in their fixed order."""
    calls = F.when(F.col("expected_call_count") == 1, "single_call").when(F.col("expected_call_count") == 2, "two_calls").otherwise("three_plus_calls")
    tags = [calls] + [F.when(F.col(c), c) for c in ("multiple_called_tools", "repeated_tool_calls")]
    tags += [F.when(F.col("available_tool_count") >= 5, "five_plus_available_tools"), F.when(F.col("complex_parameters"), "complex_parameter_types")]
    return flags.select("record_no", F.array_compact(F.array(*tags)).alias("tags"))


def namespace_counts(tools: DataFrame, top: int = 30) -> DataFrame:
    """The most frequent namespaces of tools (tool_name, row_index), ties by first row then name: a top-k report."""
    named = tools.where("tool_name is not null and tool_name <> ''").groupBy(namespace(F.col("tool_name")).alias("namespace")).agg(F.count("*").alias("n"), F.min("row_index").alias("first_row"))
    return named.orderBy(F.desc("n"), "first_row", "namespace").limit(top)
