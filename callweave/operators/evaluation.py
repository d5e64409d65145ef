"""Evaluation of a selection, replacement of what fails, and the report of both.

A selection (split, pos, id) is small and of a fixed size, so it is broadcast to its candidates and only its
raw rows go through the checks. Edge cases: a selected id without a candidate raises KeyError; open places
(null id) stay open; a fingerprint twice in one split is no issue, in two splits it is one of the later
split; a null fingerprint is no duplicate; candidates whose raw row is missing count as unreadable.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from callweave.functions.checks import CONTEXT_LIMIT, CROSS_SPLIT, UNREADABLE
from callweave.operators import selection
from callweave.operators.prepare import prepare
from callweave.operators.quality import split_rank
from callweave.session import cut
from callweave.sources import files

_ISSUES = "array<struct<category: string, message: string>>"


def _checked(rows: DataFrame, raw_rows: DataFrame, limit: int) -> DataFrame:
    """`rows` (with row_index) with the issues and the estimated length of their raw rows."""
    done = prepare(raw_rows, limit=limit).select("row_index", "issues", "estimated_tokens")
    none = F.array(F.struct(F.lit(UNREADABLE).alias("category"), F.lit("The raw row is missing.").alias("message"))).cast(_ISSUES)
    return rows.join(done, "row_index", "left").withColumn("issues", F.coalesce("issues", none))


def evaluate(selected: DataFrame, candidates: DataFrame, raw_rows: DataFrame, limit: int = CONTEXT_LIMIT) -> DataFrame:
    """split, pos, id, row_index, generator, call_bucket, fingerprint, estimated_tokens, issues of each selected record."""
    places = selected.where("id is not null").select("split", "pos", "id")
    known = cut(candidates.select("id", "row_index", "generator", "call_bucket", "fingerprint").join(F.broadcast(places), "id"))
    if lost := [r.id for r in places.join(known.select("id"), "id", "left_anti").collect()]:  # as long as the selection
        raise KeyError(f"Selected ids are no candidates: {sorted(lost)}.")
    rows = _checked(known, raw_rows.join(F.broadcast(known.select("row_index")), "row_index", "left_semi"), limit)
    owner = known.where("fingerprint is not null").groupBy("fingerprint").agg(F.min(F.struct(split_rank().alias("rank"), "split")).alias("owner"))
    rows = rows.join(owner, "fingerprint", "left")
    message = F.concat(F.lit("Example fingerprint for source id "), F.col("id").cast("string"), F.lit(" appears in both "), F.col("owner.split"), F.lit(" and "), F.col("split"), F.lit("."))
    again = F.array(F.struct(F.lit(CROSS_SPLIT).alias("category"), message.alias("message"))).cast(_ISSUES)
    issues = F.when(F.col("owner.split") != F.col("split"), F.concat("issues", again)).otherwise(F.col("issues"))
    return rows.select("split", "pos", "id", "row_index", "generator", "call_bucket", "fingerprint", "estimated_tokens", issues.alias("issues"))


@dataclass(frozen=True)
class Repair:
    """A selection before and after its replacements: entries, final selection (split, pos, id, replaced), report."""

    entries: DataFrame
    final: DataFrame
    report: dict[str, Any]


def repair(selected: DataFrame, candidates: DataFrame, raw_rows: DataFrame, limit: int = CONTEXT_LIMIT, seed: int = selection.SEED) -> Repair:
    """Evaluate a selection, let failing records give way to the next valid candidate of their pool, evaluate again.

    Raises RuntimeError if the result still has issues, LookupError if a pool has no valid candidate left.
    """
    entries = cut(evaluate(selected, candidates, raw_rows, limit))
    rows = entries.orderBy(split_rank(), "split", "pos").collect()  # the selection: fixed size
    bad = [r for r in rows if r.issues]
    passed: dict[str, int] = {}
    final, after = selected.select("split", "pos", "id", F.lit(None).cast("long").alias("replaced")), rows
    if bad:
        checked = cut(_checked(candidates.select("row_index", "id", "generator", "call_bucket", "fingerprint"), raw_rows, limit).withColumn("ok", F.size("issues") == 0))
        spark = selected.sparkSession
        failed = F.broadcast(spark.createDataFrame([(r.id,) for r in bad], "id long"))
        valid = checked.where("ok").select("id").join(failed, "id", "left_anti")
        final = cut(selection.replace(selected, candidates, valid.union(entries.where("size(issues) = 0").select("id")), seed))
        after = evaluate(final, candidates, raw_rows, limit).orderBy(split_rank(), "split", "pos").collect()
        if left := [r.id for r in after if r.issues]:
            raise RuntimeError(f"Replacements left records with issues: {left}.")
        passed = _passed_over(checked, entries, final, seed)
    new = {(r.split, r.pos): r for r in after}
    return Repair(entries, final, _report(rows, bad, new, passed, limit))


def load_selected(spark: SparkSession, folder: str, manifest: str, candidates: DataFrame, quotas: dict[str, tuple[int, ...]] | None = None, seed: int = selection.SEED) -> DataFrame:
    """(split, pos, id) of a selection: from its raw split files, else from its manifest, else selected anew."""
    if all(files.exists(spark, f"{folder}/{s}.jsonl") for s in selection.SPLITS):
        lines = files.read_splits(spark, folder, files.RAW, selection.SPLITS).withColumn("line", F.monotonically_increasing_id())
        pos = F.row_number().over(W.partitionBy("split").orderBy("line")) - 1  # the size of the selection
        return lines.select("split", pos.alias("pos"), "id")
    if files.exists(spark, manifest):
        text = "\n".join(r.value for r in spark.read.text(manifest).collect())  # one small document
        places: dict[str, list[int]] = {s: [] for s in selection.SPLITS}
        for record in json.loads(text).get("records", []):
            if record["split"] not in places:
                raise ValueError(f"Unexpected split {record['split']!r} in selection manifest.")
            places[record["split"]].append(int(record["id"]))
        return spark.createDataFrame([(s, i, n) for s, ids in places.items() for i, n in enumerate(ids)], "split string, pos int, id long")
    return selection.select(candidates, quotas, seed)


def write_selection(selected: DataFrame, candidates: DataFrame, raw_rows: DataFrame, folder: str, rejected: dict[str, int] | None = None) -> None:
    """A selection's raw split files in their order, its manifest and its summary; all of the selection's size."""
    known = cut(candidates.join(F.broadcast(selected.select("id")), "id", "left_semi"))
    rows = raw_rows.select("row_index", "query", "tools", "answers").join(F.broadcast(known.select("row_index", "id")), "row_index").join(F.broadcast(selected.select("split", "pos", "id")), "id")
    rows = cut(rows.select("split", "pos", "id", "query", "tools", "answers"))
    for split in selection.SPLITS:
        lines = files.as_lines(rows.where(F.col("split") == split).drop("split"), "pos")
        files.write_json_lines(lines, f"{folder}/{split}.jsonl", "line", "row_index", one_file=True)
    records = [r.asDict() for r in selection.manifest(selected, known).orderBy(split_rank(), "pos").collect()]
    files.write_report({"records": records, "rejected_candidate_counts": rejected or {}}, f"{folder}/manifest.json")
    files.write_report(files.as_report(selection.summary(selected, known)), f"{folder}/summary.json")


def _passed_over(checked: DataFrame, entries: DataFrame, final: DataFrame, seed: int) -> dict[str, int]:
    """Issue categories of the invalid candidates that stood before the replacements taken, each candidate once a category."""
    order = selection.pool_order(checked, selection.hash_order(seed), F.col("ok"))
    used = entries.select("fingerprint")
    taken = order.join(F.broadcast(final.where("replaced is not null").select("id")), "id", "left_semi").groupBy("generator", "call_bucket").agg(F.max("key").alias("last"))
    before = order.where("not ok").join(F.broadcast(taken), ["generator", "call_bucket"]).where("key < last").join(F.broadcast(used), "fingerprint", "left_anti")
    each = checked.select("row_index", F.explode(F.array_distinct(F.transform("issues", lambda i: i["category"]))).alias("category")).join(before.select("row_index"), "row_index")
    return {r.category: r.n for r in each.groupBy("category").agg(F.count("*").alias("n")).collect()}  # a row a category


def _categories(row: Any) -> list[str]:
    return sorted({i.category for i in row.issues})


def _report(rows: list, bad: list, new: dict, passed: dict[str, int], limit: int) -> dict[str, Any]:
    """The report as one document; its keys are fixed values."""
    about = lambda r: {"split": r.split, "generator": r.generator, "call_bucket": r.call_bucket}
    counts: dict[str, int] = {}
    for r in bad:
        for c in _categories(r):
            counts[c] = counts.get(c, 0) + 1
    sizes: dict[str, int] = {}
    for split, _ in new:
        sizes[split] = sizes.get(split, 0) + 1
    return {
        "validation_schema_version": "1.0", "context_token_limit": limit, "examples_selected": len(rows), "valid_examples": len(rows) - len(bad), "rejected_examples": len(bad),
        "replacement_examples_added": len(bad), "final_total_examples": len(new), "selected_rejection_category_counts": counts, "replacement_candidate_rejection_counts": passed,
        "rejected_records": [{**about(r), "source_id": r.id, "categories": _categories(r), "messages": [i.message for i in r.issues], "estimated_tokens": r.estimated_tokens} for r in bad],
        "replacements": [
            {
                **about(new[r.split, r.pos]), "rejected_source_id": r.id, "replacement_source_id": new[r.split, r.pos].id, "rejected_categories": _categories(r),
                "rejected_messages": [i.message for i in r.issues], "replacement_estimated_tokens": new[r.split, r.pos].estimated_tokens,
            }
            for r in bad
        ],
        "final_split_sizes": sizes,
    }
