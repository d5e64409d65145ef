"""Command line: python -m callweave COMMAND --input PATH --output PATH [options].

prepare    raw rows (parquet, or one JSON array) to canonical records as JSON lines, all or nothing
inspect    profile of raw rows as a report, with a readable preview of the sample
validate   issues of raw rows, as parquet, with --context-token-limit
select     a stratified selection of raw rows: split files, manifest, summary
repair     evaluate the selection in --selected (or its manifest, or a new one), replace what fails, write both again and the report
verify     compare the split files in --input (raw) with those in --normalized against --sizes
template   render canonical records (parquet) and check the text; exit 1 on any failure
loss-mask  token labels of canonical records (parquet)
checksums  bytes, lines and SHA-256 of the files given as --input (several allowed)

A tokenizer is named as package.module:factory; the factory gets `revision` where one is given.
"""

from __future__ import annotations

import argparse
import sys
from functools import partial
from importlib import import_module
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.checks import CONTEXT_LIMIT
from callweave.functions.records import GENERATOR_BOUNDARY
from callweave.operators import evaluation, prepare, quality, rendering, selection
from callweave.session import cut, local_session
from callweave.sources import files


def _raw(spark: SparkSession, path: str) -> DataFrame:
    return files.read_raw_array(spark, path) if path.endswith(".json") else spark.read.parquet(path)


def make_tokenizer(name: str, revision: str | None) -> Any:
    """The tokenizer that a factory named package.module:factory makes."""
    module, _, factory = name.partition(":")
    make = getattr(import_module(module), factory)
    return make(revision=revision) if revision else make()


def _picked(records: DataFrame, count: int | None) -> DataFrame:
    """All records, or as many representative ones."""
    if count is None:
        return records
    flags = quality.feature_flags(records).withColumn("split", F.lower(F.trim("split")))
    first = records.groupBy("id").agg(F.min("record_no").alias("record_no"))
    picks = selection.representatives(flags.where("split is not null and source_id is not null"), count)
    return records.join(F.broadcast(first.join(F.broadcast(picks.select("id")), "id", "left_semi").select("record_no")), "record_no", "left_semi")


def _sizes(text: str) -> dict[str, int]:
    return dict(zip(selection.SPLITS, map(int, text.split(","))))


def _ids(rows: DataFrame, column: str) -> DataFrame:
    return rows.select("split", F.col(column).cast("long").alias("id"))


def main(args: list[str] | None = None, spark: SparkSession | None = None) -> int:
    parser = argparse.ArgumentParser(prog="callweave", description=__doc__, formatter_class=argparse.RawDescriptionHelpFormatter)
    parser.add_argument("command", choices=["prepare", "inspect", "validate", "select", "repair", "verify", "template", "loss-mask", "checksums"])
    parser.add_argument("--input", required=True, nargs="+")
    parser.add_argument("--output", required=True)
    parser.add_argument("--context-token-limit", type=int, default=CONTEXT_LIMIT)
    parser.add_argument("--seed", type=int, default=selection.SEED)
    parser.add_argument("--boundary", type=int, default=GENERATOR_BOUNDARY)
    parser.add_argument("--selected", help="folder of an earlier selection")
    parser.add_argument("--normalized", help="folder of normalized split files")
    parser.add_argument("--sizes", type=_sizes, default=_sizes("120,40,40"), help="records of train, validation, test")
    parser.add_argument("--tokenizer", default="callweave.functions.chat:ChatMarkup")
    parser.add_argument("--revision")
    parser.add_argument("--count", type=int, help="as many representative records instead of all")
    parser.add_argument("--enable-thinking", action="store_true")
    parser.add_argument("--pad-to", type=int)
    options = parser.parse_args(args)
    spark, path, out = spark or local_session(), options.input[0], options.output
    tokenizer = partial(make_tokenizer, options.tokenizer, options.revision)
    match options.command:
        case "prepare":
            failed = files.write_records(prepare.prepare(_raw(spark, path), depth=prepare.RECORD), out)
            if failed:
                print(f"{failed} rows cannot be normalized; nothing was written", file=sys.stderr)
            return int(failed > 0)
        case "inspect":
            sample = selection.inspection_sample(_raw(spark, path), options.boundary, seed=options.seed, report=True)
            files.write_report(files.as_report(prepare.inspection_profile(sample)), f"{out}/profile.json")
            files.write_preview(sample, f"{out}/preview", ["row_index", "id", "query", "tools", "answers"])
        case "validate":
            rows = prepare.prepare(_raw(spark, path), limit=options.context_token_limit)
            rows.select("row_index", "id", "issues", "estimated_tokens").write.mode("overwrite").parquet(out)
        case "select" | "repair":
            raw = _raw(spark, path)
            prepared = prepare.prepare(raw, boundary=options.boundary, depth=prepare.RECORD)
            marked = cut(prepare.gated(prepared.select("gate", *prepare.CANDIDATE)))
            pool, rejected = marked.where("gate is null"), {r.gate: r.n for r in marked.where("gate is not null").groupBy("gate").agg(F.count("*").alias("n")).collect()}
            if options.command == "select":
                evaluation.write_selection(selection.select(pool, seed=options.seed), pool, raw, out, rejected)
                return 0
            before = options.selected or f"{out}/none"
            done = evaluation.repair(evaluation.load_selected(spark, before, f"{before}/manifest.json", pool, seed=options.seed), pool, raw, options.context_token_limit, options.seed)
            evaluation.write_selection(done.final, pool, raw, out, rejected)
            files.write_report(done.report, f"{out}/validation.json")
        case "verify":
            raw, normalized = files.read_splits(spark, path, files.RAW), files.read_splits(spark, options.normalized, "metadata struct<source_id: long>")
            files.write_report(quality.verification_report(_ids(raw, "id"), _ids(normalized, "metadata.source_id"), options.sizes), out)
        case "template":
            records = _picked(spark.read.parquet(path), options.count)
            rendering.rendered_reports(records, tokenizer, options.enable_thinking).write.mode("overwrite").parquet(out)
            bad = spark.read.parquet(out).where(F.col("error").isNotNull() | (F.col("failed") > 0)).count()
            return int(bad > 0)
        case "loss-mask":
            records = _picked(spark.read.parquet(path), options.count)
            rendering.token_labels(records, tokenizer, options.enable_thinking, options.pad_to).write.mode("overwrite").parquet(out)
        case "checksums":
            files.file_checksums(spark, options.input).write.mode("overwrite").json(out)
    return 0


if __name__ == "__main__":
    sys.exit(main())
