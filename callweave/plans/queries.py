"""Queries of the core operators over the tables of a data folder; their SQL is in `oracles`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from callweave.functions.checks import CONTEXT_LIMIT
from callweave.operators import badrows, evaluation, nested, prepare, quality, rendering, scoring, selection
from callweave.plans import cases
from callweave.plans.oracles import SQL as _TABLE_SQL
from callweave.session import cut, hot_join, spread, table
from callweave.sources import files

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def _clean(column: str) -> Column:
    return F.lower(F.trim(F.col(column)))


def _candidates(spark: SparkSession, folder: str) -> DataFrame:
    """The candidates table with evenly spelled split and generator."""
    return table(spark, folder, "candidates").withColumns({"split": _clean("split"), "generator": _clean("generator"), "call_bucket": F.regexp_replace(_clean("call_bucket"), "[ -]", "_")})


def _prepared(spark: SparkSession, folder: str, depth: int = prepare.CHECKED) -> DataFrame:
    """Raw rows through the preparation stage."""
    return prepare.prepare(table(spark, folder, "raw_rows"), depth=depth)


def _profiled(spark: SparkSession, folder: str) -> DataFrame:
    """The readable raw rows with their profile."""
    return _prepared(spark, folder, prepare.PROFILE).where("fingerprint is not null")


# --- nested records and bad rows -----------------------------------------------------------------


def _subtypes(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The typed subtype tables of the raw rows."""
    return nested.variant_tables(nested.routed(nested.shred(table(spark, folder, "raw_rows"))))


@query
def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return nested.nested_found(_subtypes(spark, folder))


@query
def p1_variants(spark: SparkSession, folder: str) -> DataFrame:
    return nested.variant_counts(nested.shred(table(spark, folder, "raw_rows")))


@query
def p1_subtypes(spark: SparkSession, folder: str) -> DataFrame:
    """Rows of each subtype table, and how many of them have their parent in the tables."""
    return nested.parent_links(_subtypes(spark, folder))


@query
def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.bad_rows(badrows.parse_lines(table(spark, folder, "raw_lines")))


@query
def p6_loaded(spark: SparkSession, folder: str) -> DataFrame:
    return badrows.good_rows(badrows.parse_lines(table(spark, folder, "raw_lines")))


# --- distributions and profile -------------------------------------------------------------------


@query
def call_bucket_distribution(spark: SparkSession, folder: str) -> DataFrame:
    n = F.col("expected_call_count")
    bucket = F.when(n == 1, "single_call").when(n == 2, "two_calls").when(n >= 3, "three_or_more_calls").otherwise("zero_calls")
    return _candidates(spark, folder).groupBy(bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query
def generator_distribution(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).where("generator is not null").groupBy("generator").agg(F.count("*").alias("n"))


@query
def generator_by_id(spark: SparkSession, folder: str) -> DataFrame:
    name = F.when(F.col("id") < 33_659, "deepseek").otherwise("mixtral")
    return table(spark, folder, "raw_rows").where("id is not null").groupBy(name.alias("generator")).agg(F.count("*").alias("n"))


@query
def tool_count_distribution(spark: SparkSession, folder: str) -> DataFrame:
    pairs = F.array(*(F.struct(F.lit(m).alias("measure"), F.col(c).cast("long").alias("value")) for m, c in (("tools", "available_tool_count"), ("calls", "expected_call_count"))))
    return _candidates(spark, folder).select(F.explode(pairs).alias("x")).where("x.value is not null").groupBy("x.measure", "x.value").agg(F.count("*").alias("n"))


@query
def parameter_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    return _candidates(spark, folder).select(F.explode(F.array_distinct("parameter_types")).alias("type")).where("type is not null").groupBy("type").agg(F.count("*").alias("n"))


@query
def parameter_type_occurrences(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "param_types").groupBy(F.coalesce("type", F.lit("<missing>")).alias("type")).agg(F.count("*").alias("n"))


@query
def complex_parameter_flag(spark: SparkSession, folder: str) -> DataFrame:
    flag = F.exists("parameter_types", lambda t: F.lower(t).rlike("array|dict|list|object"))
    return _candidates(spark, folder).select("row_index", F.coalesce(flag, F.lit(False)).alias("is_complex"))


@query
def distinct_tool_flags(spark: SparkSession, folder: str) -> DataFrame:
    n, d = F.col("expected_call_count"), F.col("distinct_expected_tool_count")
    return _candidates(spark, folder).where(n.isNotNull() & d.isNotNull()).select("row_index", ((n > 1) & (d == 1)).alias("repeated_same"), (d > 1).alias("multiple_distinct"))


@query
def namespace_topk(spark: SparkSession, folder: str) -> DataFrame:
    return quality.namespace_counts(table(spark, folder, "param_types"))


@query
def raw_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Rows, readable ones and distinct fingerprints per source."""
    p = prepare.prepare(table(spark, folder, "raw_rows"), depth=prepare.PROFILE, keep=("source_dataset",))
    return p.groupBy("source_dataset").agg(F.count("*").alias("n"), F.count("fingerprint").alias("readable"), F.countDistinct("fingerprint").alias("fingerprints"))


@query
def inspection_profile(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.inspection_profile(table(spark, folder, "raw_rows"))


@query
def raw_parameter_types(spark: SparkSession, folder: str) -> DataFrame:
    return _profiled(spark, folder).select(F.explode("type_occurrences").alias("type")).groupBy("type").agg(F.count("*").alias("n"))


@query
def derived_analysis(spark: SparkSession, folder: str) -> DataFrame:
    p = _profiled(spark, folder)
    keys = F.to_json("argument_keys")
    return p.select(
        "row_index", "available_tool_count", "expected_call_count", "available_tool_names", "expected_tool_names", "unknown_answer_tools", "parameter_types", "call_bucket",
        "distinct_expected_tool_count", "repeated_same_tool", "multiple_distinct_tools", "has_complex_parameters", keys.alias("argument_keys"), (F.col("expected_call_count") > 1).alias("needs_review"),
    )


# --- fingerprints, lengths, duplicates -----------------------------------------------------------


@query
def fingerprint_documents(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", quality.text_fingerprint(F.col("text")).alias("fingerprint"))


@query
def duplicate_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    rows = _candidates(spark, folder).select("row_index", "fingerprint")
    return quality.duplicate_groups(rows, "fingerprint").select("fingerprint", "n", "first_row")


@query
def record_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    """The first row with the fingerprint of each readable row."""
    p = _profiled(spark, folder).select("row_index", "fingerprint")
    first = p.groupBy("fingerprint").agg(F.min("row_index").alias("first_row"), F.count("*").alias("n"))
    return hot_join(p, cut(first), "fingerprint").select("row_index", "first_row", "n")


@query
def token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "documents").where("text is not null").select("doc_id", quality.token_estimate(F.col("text")).alias("tokens"))


@query
def context_limit_filter(spark: SparkSession, folder: str) -> DataFrame:
    return token_estimate(spark, folder).where(F.col("tokens") > CONTEXT_LIMIT)


@query
def cross_split_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    return quality.cross_split_duplicates(_candidates(spark, folder)).select("id", "split", "owner", "fingerprint")


@query
def split_verification(spark: SparkSession, folder: str) -> DataFrame:
    return quality.split_report(_candidates(spark, folder))


@query
def split_id_match(spark: SparkSession, folder: str) -> DataFrame:
    """Ids of the candidates against those of the canonical records, split by split."""
    left = _candidates(spark, folder).where("id is not null and split is not null").select("split", "id")
    meta = table(spark, folder, "canonical_records").select(F.lower(F.trim("metadata.split")).alias("split"), F.col("metadata.source_id").alias("id"))
    return quality.id_mismatches(left, meta.where("id is not null and split is not null"))


@query
def arrival_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Rows per day of arrival, and how many came more than a day after they were made."""
    late = F.col("ingested_at") > F.col("created_at") + F.expr("INTERVAL 1 DAY")
    return table(spark, folder, "raw_rows").where("ingested_at is not null").groupBy(F.date_format("ingested_at", "yyyy-MM-dd").alias("day")).agg(F.count("*").alias("n"), F.count_if(late).alias("late"))


# --- canonical records ---------------------------------------------------------------------------


@query
def expected_calls(spark: SparkSession, folder: str) -> DataFrame:
    return quality.expected_calls(table(spark, folder, "canonical_records"))


@query
def call_membership(spark: SparkSession, folder: str) -> DataFrame:
    """Calls per record and how many of them name a listed tool."""
    r = table(spark, folder, "canonical_records")
    known, names = F.transform("tools", lambda t: t["function"]["name"]), quality.call_names()
    return r.select("record_no", F.size(names).alias("calls"), F.size(F.filter(names, lambda n: F.array_contains(known, n))).alias("known_calls"))


@query
def unknown_tools(spark: SparkSession, folder: str) -> DataFrame:
    """Tools that the readable raw rows call but do not list."""
    return _profiled(spark, folder).select("row_index", F.explode("unknown_answer_tools").alias("tool"))


@query
def repeated_calls(spark: SparkSession, folder: str) -> DataFrame:
    f = quality.feature_flags(table(spark, folder, "canonical_records"))
    return f.select("record_no", "repeated_tool_calls", "multiple_called_tools")


@query
def feature_tags(spark: SparkSession, folder: str) -> DataFrame:
    tags = quality.feature_tags(quality.feature_flags(table(spark, folder, "canonical_records")))
    return tags.select("record_no", F.array_join("tags", ",").alias("tags"))


@query
def representative_pick(spark: SparkSession, folder: str) -> DataFrame:
    f = quality.feature_flags(table(spark, folder, "canonical_records")).withColumn("split", _clean("split"))
    return selection.representatives(f.where("split is not null and source_id is not null"))


@query
def render_chatml(spark: SparkSession, folder: str) -> DataFrame:
    """Rendered text of each record, its tokens and how many of the checks fail."""
    t = rendering.template_checks(table(spark, folder, "canonical_records"))
    return t.select("record_no", "rendered_text", "token_count", F.size("failures").alias("failures"))


@query
def tagged_section(spark: SparkSession, folder: str) -> DataFrame:
    """Tool section, delimiters and thinking of the rendered records, by native expressions."""
    t = rendering.template_checks(table(spark, folder, "canonical_records")).select("record_no", "rendered_text")
    return rendering.sections(t).drop("rendered_text")


@query
def document_markers(spark: SparkSession, folder: str) -> DataFrame:
    """Documents that hold rendered call tags or thinking blocks."""
    s = rendering.sections(table(spark, folder, "documents").where("text is not null").select("doc_id", "text"), "text")
    return s.where(F.size("delimiters") > 0).select("doc_id", F.array_join("delimiters", " ").alias("marks"), "has_thinking")


@query
def chat_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.chat_blocks(table(spark, folder, "canonical_records"))


@query
def loss_spans(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.loss_spans(table(spark, folder, "canonical_records"))


@query
def token_labels(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.token_labels(table(spark, folder, "canonical_records")).drop("token_id").withColumn("label", (F.col("label") != -100).cast("int"))


@query
def mask_counts(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.mask_counts(rendering.token_labels(table(spark, folder, "canonical_records")))


@query
def mask_diagnostic(spark: SparkSession, folder: str) -> DataFrame:
    return rendering.mask_diagnostics(table(spark, folder, "canonical_records"))


@query
def delimiters(spark: SparkSession, folder: str) -> DataFrame:
    """Chat logs by the call tags that they hold."""
    s = rendering.sections(table(spark, folder, "documents").where("text is not null").select("source", "text"), "text")
    return s.select(F.coalesce("source", F.lit("unknown")).alias("source"), F.explode("delimiters").alias("mark")).groupBy("source", "mark").agg(F.count("*").alias("n"))


@query
def thinking_check(spark: SparkSession, folder: str) -> DataFrame:
    """Documents with and without thinking content."""
    s = rendering.sections(table(spark, folder, "documents").where("text is not null").select("text"), "text")
    return s.groupBy("has_thinking").agg(F.count("*").alias("n"))


@query
def record_token_estimate(spark: SparkSession, folder: str) -> DataFrame:
    """Estimated rendered length of each canonical record."""
    return rendering.estimated_lengths(table(spark, folder, "canonical_records"))


@query
def json_props_decode(spark: SparkSession, folder: str) -> DataFrame:
    """Events by the decoded number in their properties."""
    k = F.from_json("props", "k bigint", {"mode": "PERMISSIVE", "allowSingleQuotes": "false"})["k"]
    return table(spark, folder, "events").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


# --- annotations, normalization, validation ------------------------------------------------------


@query
def type_schema_map(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.type_schemas(table(spark, folder, "param_types"))


@query
def annotated_default(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.type_schemas(table(spark, folder, "param_types")).where("default_value is not null").select("type", "default_value")


@query
def json_type_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Parameters per JSON type of their annotation, each distinct annotation compiled once."""
    t = prepare.typed_parameters(table(spark, folder, "param_types").select("param_id", "type"))
    kind = F.when(F.col("type").isNull(), "missing").when(F.col("error").isNotNull(), "unsupported").otherwise(F.coalesce("json_type", F.lit("other")))
    return t.groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


@query
def normalize_records(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder, prepare.RECORD).select("row_index", "id", "record", "error")


@query
def candidate_gate(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.gated(_prepared(spark, folder, prepare.RECORD).select("row_index", "id", "gate")).select("row_index", F.coalesce("gate", F.lit("eligible")).alias("gate"))


@query
def rejection_taxonomy(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.rejections(_prepared(spark, folder, prepare.RECORD))


@query
def validate_issues(spark: SparkSession, folder: str) -> DataFrame:
    return _prepared(spark, folder).select("row_index", "estimated_tokens", F.explode("issues").alias("i")).select("row_index", "estimated_tokens", "i.category", "i.message")


@query
def issue_counts(spark: SparkSession, folder: str) -> DataFrame:
    return prepare.issue_counts(_prepared(spark, folder))


@query
def first_of_id(spark: SparkSession, folder: str) -> DataFrame:
    """The lowest row of each id and how often the id stands: who owns an id."""
    return table(spark, folder, "raw_rows").where("id is not null").groupBy("id").agg(F.min("row_index").alias("first_row"), F.count("*").alias("n"))


# --- selection -----------------------------------------------------------------------------------


def _eligible(spark: SparkSession, folder: str) -> DataFrame:
    c = _candidates(spark, folder).where("id is not null and generator is not null and call_bucket is not null and fingerprint is not null")
    first = c.groupBy("id").agg(F.min("row_index").alias("row_index"))
    return c.join(first, ["id", "row_index"])


@query
def pool_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return selection.pool_sizes(_eligible(spark, folder))


@query
def pool_heads(spark: SparkSession, folder: str) -> DataFrame:
    return selection.pool_heads(_eligible(spark, folder), 200).select("generator", "call_bucket", "pool_pos", "row_index", "id", "fingerprint")


@query
def stratified_split(spark: SparkSession, folder: str) -> DataFrame:
    """The selection with the default quotas; places that a short pool leaves open have a null id and its name."""
    return selection.select_reported(_eligible(spark, folder))


@query
def selected_records(spark: SparkSession, folder: str) -> DataFrame:
    """The records of the selection with their pool; the order within a split is a seeded shuffle and left out."""
    e = _eligible(spark, folder)
    return e.select("id", "generator", "call_bucket").join(F.broadcast(selection.select_reported(e).where("id is not null").select("split", "id")), "id")


@query
def selection_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Counts of the selection; measure 'short' counts the open places by split and pool.

    Unknown tools are those that the preparation stage finds in the rows of the selection; null for unreadable rows.
    """
    e = _eligible(spark, folder)
    chosen = selection.select_reported(e)
    members = e.join(F.broadcast(chosen.select("id")), "id", "left_semi")
    raw = table(spark, folder, "raw_rows").join(F.broadcast(members.select("row_index")), "row_index", "left_semi")
    e = members.join(prepare.prepare(raw, depth=prepare.PROFILE).select("row_index", "unknown_answer_tools"), "row_index", "left")
    gaps = chosen.where("id is null").groupBy(F.lit("short").alias("measure"), F.concat_ws("/", "split", "short").alias("value")).agg(F.count("*").alias("n"))
    return selection.summary(chosen.where("id is not null"), e).unionByName(gaps)


@query
def replacement(spark: SparkSession, folder: str) -> DataFrame:
    """A selection whose members with issues in the validation stage, or without a record, give way."""
    e = _eligible(spark, folder)
    sound = _prepared(spark, folder).where("record is not null and size(issues) = 0").select("row_index")
    valid = cut(e.join(sound, "row_index", "left_semi").select("id"))  # read twice
    return selection.replace(selection.select_reported(e), e, valid, report=True)


@query
def selection_issues(spark: SparkSession, folder: str) -> DataFrame:
    """The evaluation of the selection: each record with its estimated length and issue categories."""
    e = _eligible(spark, folder)
    rows = evaluation.evaluate(selection.select_reported(e), e, table(spark, folder, "raw_rows"))
    return rows.select("split", "id", "estimated_tokens", F.transform("issues", lambda i: i["category"]).alias("categories"))


@query
def inspection_sample(spark: SparkSession, folder: str) -> DataFrame:
    """50 rows on either side of the boundary; a table that ends before it has those below only."""
    return selection.inspection_sample(table(spark, folder, "raw_rows"), report=True).select("side", "row_index", "id", "query")


@query
def category_examples(spark: SparkSession, folder: str) -> DataFrame:
    return selection.category_examples(table(spark, folder, "candidates"))


# --- model output --------------------------------------------------------------------------------


def _outputs(spark: SparkSession, folder: str) -> DataFrame:
    """Each record's calls as expected, and as predicted after an edit that record_no modulo 8 names.

    0 none, 1 in reverse and within prose, 2 first call renamed, 3 its arguments replaced, 4 its values
    replaced, 5 its arguments left out, 6 last call left out, 7 prose only.
    """
    r = table(spark, folder, "canonical_records")
    calls = F.flatten(F.transform(F.filter("messages", lambda m: m["tool_calls"].isNotNull()), lambda m: m["tool_calls"]))
    body = F.transform(calls, lambda c: c["function"])
    r = r.select("record_no", F.lower(F.trim("metadata.split")).alias("split"), (F.col("record_no") % 8).alias("edit"), body.alias("body"))
    first, rest = F.slice("body", 1, 1), F.slice("body", 2, 1_000_000)
    call = lambda name, arguments: F.struct(name.alias("name"), arguments.alias("arguments"))
    values = lambda c: F.to_json(F.transform_values(F.from_json(c["arguments"], "map<string,string>"), lambda k, v: F.lit("zz")))
    edits = {
        1: F.reverse("body"), 2: F.concat(F.transform(first, lambda c: call(F.concat(F.lit("zz_"), c["name"]), c["arguments"])), rest),
        3: F.concat(F.transform(first, lambda c: call(c["name"], F.lit('{"zz":1}'))), rest), 4: F.concat(F.transform(first, lambda c: call(c["name"], values(c))), rest),
        5: F.concat(F.transform(first, lambda c: call(c["name"], F.lit(None).cast("string"))), rest), 6: F.slice("body", 1, F.greatest(F.size("body") - 1, F.lit(0))),
    }
    edited = F.col("body")
    for k, calls_ in edits.items():
        edited = F.when(F.col("edit") == k, calls_).otherwise(edited)
    r = r.withColumn("edited", edited)
    text = F.when(F.col("edit") == 7, "I cannot do that.").when(F.col("edit") == 1, F.concat(F.lit("Sure. "), F.to_json("edited"), F.lit(" Done."))).otherwise(F.to_json("edited"))
    return r.select("record_no", "split", "edit", "body", "edited", F.to_json("body").alias("expected"), text.alias("predicted"))


@query
def parse_calls(spark: SparkSession, folder: str) -> DataFrame:
    """Calls found in the text of every document; a null text is an empty output."""
    p = spread(table(spark, folder, "documents").select("doc_id", "text")).select("doc_id", scoring.parse_calls("text").alias("p"))
    return p.select("doc_id", F.size("p.calls").alias("calls"), "p.valid_structure", F.size("p.errors").alias("errors"), "p.had_extra_prose")


@query
def score_single(spark: SparkSession, folder: str) -> DataFrame:
    return _outputs(spark, folder).select("record_no", scoring.score_call("predicted", "expected").alias("s")).select("record_no", "s.*").drop("parse_errors")


@query
def score_unordered(spark: SparkSession, folder: str) -> DataFrame:
    return _outputs(spark, folder).select("record_no", scoring.score_calls("predicted", "expected").alias("s")).select("record_no", "s.*").drop("parse_errors")


@query
def score_ordered(spark: SparkSession, folder: str) -> DataFrame:
    return _outputs(spark, folder).select("record_no", scoring.score_calls_ordered("predicted", "expected").alias("s")).select("record_no", "s.*").drop("parse_errors")


@query
def score_accuracy(spark: SparkSession, folder: str) -> DataFrame:
    scored = _outputs(spark, folder).withColumn("s", scoring.score_calls("predicted", "expected")).where("split is not null")
    return scoring.accuracy(scored, "s", "split")


@query
def same_call_sets(spark: SparkSession, folder: str) -> DataFrame:
    """Complete matches without Python: the sorted texts of the predicted calls against those of the expected ones."""
    texts = lambda column: F.transform(column, lambda c: F.concat(c["name"], F.lit("\u0001"), c["arguments"]))
    same = scoring.same_calls(texts("edited"), texts("body")) & (F.col("edit") != 7)
    return _outputs(spark, folder).select("record_no", F.coalesce(same, F.lit(False)).alias("same"))


# --- files ---------------------------------------------------------------------------------------


@query
def file_checksums(spark: SparkSession, folder: str) -> DataFrame:
    """Checksums of all tables' files."""
    c = files.file_checksums(spark, [f"{folder}/*.parquet"])
    return c.select(F.regexp_extract("path", "([^/]+)(?:/part[^/]*)?$", 1).alias("name"), "bytes", "line_count", "sha256")


QUERIES |= cases.CASES
SQL: dict[str, str] = {**_TABLE_SQL, **cases.SQL}
