"""Queries of the training-data operators, and the SQL that says the same where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from callweave.llm import abuse, canonical_map, mixing, near_duplicates, overlap, packing, stratified
from callweave.llm.oracles import SQL  # noqa: F401  (part of this module's interface)
from callweave.session import table

Query = Callable[[SparkSession, str], DataFrame]


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.found(table(spark, folder, "canonical_records"))


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    return overlap.report(table(spark, folder, "canonical_records")).drop("longest_span")


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_map.found(spark, table(spark, folder, "param_types"), table(spark, folder, "type_catalog"))


def p3_unmatched(spark: SparkSession, folder: str) -> DataFrame:
    return canonical_map.unmatched(spark, table(spark, folder, "param_types"), table(spark, folder, "type_catalog"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return stratified.found(table(spark, folder, "candidates"), table(spark, folder, "sample_targets"))


def p4_sample(spark: SparkSession, folder: str) -> DataFrame:
    return stratified.sample(table(spark, folder, "candidates"), table(spark, folder, "sample_targets"))


def p4_report(spark: SparkSession, folder: str) -> DataFrame:
    return stratified.report(table(spark, folder, "candidates"), table(spark, folder, "sample_targets"))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.found(table(spark, folder, "raw_rows"))


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return near_duplicates.groups(table(spark, folder, "raw_rows"))


def p7_pack(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), table(spark, folder, "pack_capacities"))


def p7_report(spark: SparkSession, folder: str) -> DataFrame:
    return packing.report(table(spark, folder, "documents"), table(spark, folder, "pack_capacities"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.found(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_needs(spark: SparkSession, folder: str) -> DataFrame:
    """Size, budget, wanted size and copies per document of each source, in characters."""
    return mixing.needs(mixing.by_characters(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))


def p8_mix(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.mix(mixing.by_tokens(table(spark, folder, "documents")), table(spark, folder, "mix_targets"))[0]


def p8_report(spark: SparkSession, folder: str) -> DataFrame:
    return mixing.report(*mixing.mix(mixing.by_tokens(table(spark, folder, "documents")), table(spark, folder, "mix_targets")))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.found(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_scores(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.scores(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return abuse.rates(table(spark, folder, "documents"), table(spark, folder, "doc_labels"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (p2_found, p2_report, p3_found, p3_unmatched, p4_found, p4_sample, p4_report, p5_found, p5_groups, p7_pack, p7_report, p8_found, p8_needs, p8_mix, p8_report, p9_found, p9_scores, p9_rates)
}
