import json
import random

import pytest
from pyspark.sql import functions as F

from callweave.operators import evaluation, prepare, quality, rendering, scoring, selection
from callweave.plans import queries
from callweave.sources import files
from callweave.streaming import rowlocal


def pools(spark, per=(60, 25, 15), extra=0):
    rows, n = [], 0
    for g in selection.GENERATORS:
        for b, k in zip(prepare.BUCKETS, per):
            for _ in range(k + extra):
                rows.append((n, n, g, b, f"f{n}", 1, 1, False, False, ["int"], False, []))
                n += 1
    return spark.createDataFrame(rows, "row_index long, id long, generator string, call_bucket string, fingerprint string, available_tool_count int, expected_call_count int, repeated_same_tool boolean, multiple_distinct_tools boolean, parameter_types array<string>, has_complex_parameters boolean, unknown_answer_tools array<string>")


def test_selection_fills_quotas_once_and_again_alike(spark):
    c = pools(spark)
    first = selection.select(c)
    rows = first.join(c, "id").collect()
    assert len(rows) == len({r.id for r in rows}) == len({r.fingerprint for r in rows}) == 200
    count = lambda **kw: sum(all(r[k] == v for k, v in kw.items()) for r in rows)
    assert (count(split="train"), count(split="validation"), count(split="test")) == (120, 40, 40)
    assert count(split="train", call_bucket="two_calls", generator="mixtral") == 15 and count(generator="deepseek") == 100
    assert sorted(map(tuple, first.collect())) == sorted(map(tuple, selection.select(c).collect()))
    public = selection.manifest(first, c.withColumn("distinct_expected_tool_count", F.lit(1)))
    assert public.count() == 200 and "fingerprint" not in public.columns
    total = {(r.measure, r.value): r.n for r in selection.summary(first, c).collect()}
    assert total["split", "test"] == 40 and total["parameter_type", "int"] == 200
    with pytest.raises(LookupError):
        selection.select(c.where("id > 5"))
    with pytest.raises(ValueError, match="even"):
        selection.select(c, {"train": (3, 2, 2)})


def test_truncated_pools_pick_as_whole_pools_would(spark, monkeypatch):
    rng = random.Random(1)
    rows = [(i, i, rng.choice(selection.GENERATORS), rng.choice(prepare.BUCKETS), f"f{rng.randint(0, 60)}") for i in range(400)]
    c = spark.createDataFrame(rows, "row_index long, id long, generator string, call_bucket string, fingerprint string")
    quotas = {"train": (4, 2, 2), "test": (2, 2, 2)}
    whole = selection.pool_heads(c, 10_000).collect()
    cut = selection.pool_heads(c, 14).collect()
    shape = lambda heads: selection.pick([(r.generator, r.call_bucket, r.pool_pos, r.fingerprint, r.id) for r in heads], quotas)
    assert shape(whole) == shape(cut)
    monkeypatch.setattr(selection, "RANGE_ROWS", 30)
    order = selection.shuffled_heads(c, 400).orderBy("generator", "call_bucket", "pool_pos").collect()
    assert sorted(r.id for r in order) == list(range(400))
    rng, want = random.Random(selection.SEED), {}
    for g in selection.GENERATORS:  # one generator shuffles all pools, each in the order of its rows
        for b in prepare.BUCKETS:
            want[g, b] = [r[0] for r in rows if r[2:4] == (g, b)]
            rng.shuffle(want[g, b])
    for pool, ids in want.items():
        assert [r.id for r in order if (r.generator, r.call_bucket) == pool] == ids
    monkeypatch.setattr(selection, "MOST_SHUFFLED", 10)
    with pytest.raises(ValueError, match="hash order"):
        selection.shuffled_heads(c, 5)
    monkeypatch.undo()
    few = selection.shuffled_heads(c, 5).collect()
    assert all(want[r.generator, r.call_bucket][r.pool_pos] == r.id for r in few) and len(few) == 30


def test_replacement_stays_in_place_and_pool(spark):
    c = pools(spark, extra=3)
    chosen = selection.select(c)
    bad = chosen.orderBy("id").first().id
    out = selection.replace(chosen, c, c.where(F.col("id") != bad)).collect()
    new = [r for r in out if r.replaced is not None]
    assert len(out) == 200 and [r.replaced for r in new] == [bad] and bad not in {r.id for r in out}
    info = {r.id: (r.generator, r.call_bucket) for r in c.collect()}
    assert info[new[0].id] == info[bad]
    with pytest.raises(LookupError):
        selection.replace(chosen, c, chosen.where(F.col("id") != bad))


def test_queries_keep_the_quotas_and_report_short_pools(spark, tmp_path):
    def save(name, c):
        c.withColumns({"split": F.lit("train"), "distinct_expected_tool_count": F.lit(1)}).drop("unknown_answer_tools").write.parquet(str(tmp_path / name / "candidates.parquet"))
        rows = c.select("row_index", "id", F.lit("q").alias("query"), F.lit('[{"name": "t"}]').alias("tools"), F.when(F.col("id") == 0, '[{"name": "u"}]').when(F.col("id") == 1, "x").otherwise('[{"name": "t"}]').alias("answers"))
        rows.write.parquet(str(tmp_path / name / "raw_rows.parquet"))
        return str(tmp_path / name)

    c = pools(spark)
    rows = queries.stratified_split(spark, save("full", c)).collect()  # the smallest pools have the 15 rows that they need
    assert len(rows) == 200 and all(r.id is not None and r.short is None for r in rows)
    last = c.where("generator = 'mixtral' and call_bucket = 'three_or_more_calls'").orderBy("id").first().id
    folder = save("short", c.where(f"id < {last + 13}"))
    rows = queries.stratified_split(spark, folder).collect()
    assert len({(r.split, r.pos) for r in rows}) == 200 and len({r.id for r in rows if r.id is not None}) == 198
    assert [(r.split, r.short) for r in rows if r.id is None] == [("test", "mixtral/three_or_more_calls")] * 2
    assert [(r.value, r.n) for r in queries.selection_summary(spark, folder).where("measure = 'short'").collect()] == [("test/mixtral/three_or_more_calls", 2)]
    unknown = {r.value: r.n for r in queries.selection_summary(spark, folder).where("measure = 'unknown_tools'").collect()}
    assert unknown == {"true": 1, None: 1, "false": 196}


def test_replacement_goes_by_the_validation_stage(spark, tmp_path):
    c = pools(spark, extra=2)
    faulty = [r.id for r in selection.select(c).orderBy("id").limit(2).collect()]
    tool, call = json.dumps([{"name": "t", "description": "d", "parameters": {"a": {"type": "str", "description": "d"}}}]), json.dumps([{"name": "t", "arguments": {"a": "x"}}])
    c.withColumns({"split": F.lit("train"), "distinct_expected_tool_count": F.lit(1)}).drop("unknown_answer_tools").write.parquet(str(tmp_path / "candidates.parquet"))
    answers = F.when(F.col("id") == faulty[0], call.replace('"t"', '"u"')).when(F.col("id") == faulty[1], call.replace('"x"', "5")).otherwise(call)
    c.select("row_index", "id", F.lit("q").alias("query"), F.lit(tool).alias("tools"), answers.alias("answers")).write.parquet(str(tmp_path / "raw_rows.parquet"))
    out = queries.replacement(spark, str(tmp_path)).collect()
    assert sorted(r.replaced for r in out if r.replaced is not None) == faulty
    assert len({r.id for r in out}) == 200 and not {r.id for r in out} & set(faulty) and any(r.id % 10 == 7 for r in out)


def repairable(spark, faults):
    """Candidates and raw rows: pools of six, ids in `faults` have a call to an unknown tool, a null argument type or both."""
    c = pools(spark, (6, 6, 6))
    tool = json.dumps([{"name": "t", "description": "d", "parameters": {"a": {"type": "str", "description": "d"}}}])
    call = json.dumps([{"name": "t", "arguments": {"a": "x"}}])
    answers = F.lit(call)
    for i, text in faults.items():
        answers = F.when(F.col("id") == i, text).otherwise(answers)
    return c, c.select("row_index", "id", F.lit("q").alias("query"), F.lit(tool).alias("tools"), answers.alias("answers"))


def test_selection_is_evaluated_repaired_and_evaluated_again(spark):
    quotas = {"train": (2, 2, 2), "validation": (2, 2, 2), "test": (2, 2, 2)}
    c, raw = repairable(spark, {})
    chosen = selection.select(c, quotas).orderBy("split", "pos").collect()
    ids = [r.id for r in chosen]
    twin = {r.id: r.fingerprint for r in c.collect()}
    train, test = next(r.id for r in chosen if r.split == "train"), next(r.id for r in chosen if r.split == "test")
    wrong = next(r.id for r in chosen if r.split == "validation")
    pool = c.where(f"id = {wrong}").first()
    spare = c.where((F.col("generator") == pool.generator) & (F.col("call_bucket") == pool.call_bucket) & ~F.col("id").isin(ids)).orderBy(selection.hash_order()).collect()
    c, raw = repairable(spark, {wrong: '[{"name": "u"}]', spare[0].id: '[{"name": "t", "arguments": {"a": 5}}]'})
    c = c.withColumn("fingerprint", F.when(F.col("id") == test, twin[train]).otherwise(F.col("fingerprint")))
    selected = spark.createDataFrame([(r.split, r.pos, r.id) for r in chosen], "split string, pos int, id long")
    entries = {r.id: r for r in evaluation.evaluate(selected, c, raw).collect()}
    assert {i: [x.category for x in r.issues] for i, r in entries.items() if r.issues} == {test: ["duplicate_cross_split"], wrong: ["unavailable_expected_tool"]}
    assert entries[test].issues[0].message == f"Example fingerprint for source id {test} appears in both train and test."
    done = evaluation.repair(selected, c, raw)
    final = {(r.split, r.pos): r for r in done.final.collect()}
    assert len(final) == 18 and {r.replaced for r in final.values()} == {None, test, wrong}
    new = next(r for r in final.values() if r.replaced == wrong)
    assert new.id == spare[1].id and new.split == "validation"
    report = done.report
    assert (report["examples_selected"], report["rejected_examples"], report["valid_examples"], report["final_total_examples"]) == (18, 2, 16, 18)
    assert report["selected_rejection_category_counts"] == {"duplicate_cross_split": 1, "unavailable_expected_tool": 1}
    assert report["replacement_candidate_rejection_counts"] == {"incompatible_argument_type": 1}
    assert [x["replacement_source_id"] for x in report["replacements"] if x["rejected_source_id"] == wrong] == [spare[1].id]
    assert report["final_split_sizes"] == {"train": 6, "validation": 6, "test": 6}
    clean = evaluation.repair(done.final, c, raw)
    assert clean.report["rejected_examples"] == 0 and clean.report["replacements"] == []
    open_place = spark.createDataFrame([("train", 0, None), ("test", 0, ids[0])], "split string, pos int, id long")
    clash = c.withColumns({"split": F.lit("x"), "pos": F.lit(1), "issues": F.lit(2), "owner": F.lit(3)})
    assert [(r.split, r.id) for r in evaluation.evaluate(open_place, clash, raw.withColumn("gate", F.lit("x"))).collect()] == [("test", ids[0])]
    assert evaluation.evaluate(open_place.limit(0), c, raw).count() == 0
    gone = evaluation.evaluate(open_place, c.withColumn("fingerprint", F.lit(None).cast("string")), raw.limit(0)).first()
    assert [i.category for i in gone.issues] == ["unparseable_expected_calls"]
    with pytest.raises(KeyError):
        evaluation.evaluate(spark.createDataFrame([("train", 0, 10_000)], "split string, pos int, id long"), c, raw)


def test_inspection_counts_faults(spark):
    rows = [(None, "[]", "[]"), (" ", "[]", "[]"), ("q", "[", "[]"), ("q", "[]", "x"), ("q", None, "[]"), ("q", "[]", "{}"), ("q", '[{"name": "a.b", "parameters": {"x": {"type": "int"}, "y": {}}}, 5]', "[1, 2]")]
    out = {(r.measure, r.value): r.n for r in prepare.inspection_profile(spark.createDataFrame(rows, "query string, tools string, answers string")).collect()}
    assert out == {
        ("fault", "query_not_string"): 1, ("fault", "query_empty"): 1, ("fault", "tools_invalid_json"): 1, ("fault", "answers_invalid_json"): 1, ("fault", "tools_not_list"): 1, ("fault", "answers_not_list"): 1,
        ("fault", "none"): 1, ("fault", "tool_not_object"): 1, ("tools", "2"): 1, ("calls", "2"): 1, ("namespace", "a"): 1, ("parameter_type", "int"): 1, ("parameter_type", "<missing>"): 1,
    }


def test_inspection_of_no_rows(spark):
    assert prepare.inspection_profile(spark.createDataFrame([], "query string, tools string, answers string, fault string")).count() == 0
    with pytest.raises(ValueError, match="has only 3 rows"):
        selection.inspection_sample(spark.range(3).toDF("row_index"))
    assert [(r.side, r.row_index) for r in selection.inspection_sample(spark.range(3).toDF("row_index"), 2, each=1, report=True).orderBy("row_index").collect()][-1] == ("from", 2)
    assert selection.inspection_sample(spark.range(0).toDF("row_index"), report=True).count() == 0


def test_preparation_goes_as_deep_as_asked(spark):
    tool, call = json.dumps([{"name": "t", "parameters": {"a": {"type": "str"}}}]), json.dumps([{"name": "t", "arguments": {"a": 1}}])
    df = spark.createDataFrame([(0, 1, "q", tool, call, "s"), (1, 2, "q", tool.replace("str", "Foo"), call, None)], "row_index long, id long, query string, tools string, answers string, source string")
    a, b, c = ({r.row_index: r for r in prepare.prepare(df, depth=d, keep=("source",)).collect()} for d in (prepare.PROFILE, prepare.RECORD, prepare.CHECKED))
    assert a[0].fingerprint == b[0].fingerprint == c[0].fingerprint and [x[0].source for x in (a, b, c)] == ["s"] * 3
    assert a[0].record is None and a[1].gate is None and b[0].record == c[0].record and b[1].gate == c[1].gate == "normalization_unsupported_parameter_types"
    assert b[0].issues is None and [i.category for i in c[0].issues] == ["incompatible_argument_type"]
    with pytest.raises(ValueError, match="cannot be kept"):
        prepare.prepare(df.withColumn("gate", F.lit(1)), keep=("gate",))


def test_hot_keys_leave_the_shuffle(spark, monkeypatch):
    from callweave import session

    rows = spark.createDataFrame([(k, i) for k, n in ((1, 50), (2, 3), (None, 2)) for i in range(n)], "k long, i long")
    keys = spark.createDataFrame([(1, 50, "a"), (2, 3, "b"), (3, 9, "c")], "k long, n long, v string")
    for how in ("inner", "left"):
        want = sorted(map(tuple, rows.join(keys, "k", how).collect()), key=repr)
        for hot in (5, 1000):
            monkeypatch.setattr(session, "HOT_ROWS", hot)
            assert sorted(map(tuple, session.hot_join(rows, keys, "k", how=how).collect()), key=repr) == want


def test_representatives_pass_over_copies_of_a_picked_id(spark):
    three = ("a", "train", 1, 3, 5, False, True, True)
    rows = [three] * 12 + [("b", "train", 2, 4, 1, False, True, False), ("c", "test", 3, 1, 6, False, False, True), ("d", "test", 4, 2, 1, False, False, False), ("e", "test", 5, 2, 1, False, False, False)]
    r = spark.createDataFrame(rows, "id string, split string, source_id long, expected_call_count int, available_tool_count int, multiple_called_tools boolean, repeated_tool_calls boolean, complex_parameters boolean")
    got = [tuple(x) for x in selection.representatives(r).orderBy("pos").collect()]
    assert got == [(0, "single_call", "c"), (1, "three_plus_calls", "a"), (2, "repeated_tool_calls", "b"), (3, "fill", "d"), (4, "fill", "e")]
    tools = selection.representatives(r.where("id <> 'c'").unionByName(r.where("id = 'c'").withColumn("expected_call_count", F.lit(2)))).orderBy("pos").collect()
    assert [(x.feature, x.id) for x in tools] == [("three_plus_calls", "a"), ("repeated_tool_calls", "b"), ("five_plus_available_tools", "c"), ("fill", "d"), ("fill", "e")]


def test_gates_count_an_id_once(spark):
    tool = json.dumps([{"name": "t", "parameters": {"a": {"type": "str"}}}])
    call = json.dumps([{"name": "t", "arguments": {}}])
    rows = [(0, 1, "q", tool, "x"), (1, 1, "q", tool, call), (2, 1, "q", tool, '[{"name": "u"}]'), (3, 1, "q", tool, call), (4, None, "q", tool, call), (5, 2, " ", tool, call), (6, 3, "q", tool.replace("str", "Foo"), call)]
    p = prepare.prepare(spark.createDataFrame(rows, "row_index long, id long, query string, tools string, answers string"))
    assert {r.row_index: r.gate for r in prepare.gated(p).collect()} == {0: "invalid_record", 1: None, 2: "duplicate_id", 3: "duplicate_id", 4: "invalid_source_id", 5: "invalid_record", 6: "normalization_unsupported_parameter_types"}
    assert [r.row_index for r in prepare.candidates(p).collect()] == [1]
    native = p.where("error is not null and fingerprint is not null").select("gate", prepare.rejection_column(F.col("error")).alias("n"))
    assert all(r.gate == r.n for r in native.collect())
    assert {r.category: r.n for r in prepare.issue_counts(p).collect()} == {"unparseable_expected_calls": 1, "unavailable_expected_tool": 1, "invalid_tool_schema": 2}


def test_types_are_compiled_once_each(spark):
    t = spark.createDataFrame([(1, "int"), (2, "int"), (3, None), (4, "Foo"), (5, "str, default (1, 2)"), (6, "int, default {1}")], "param_id long, type string")
    out = {r.param_id: r for r in prepare.typed_parameters(t).collect()}
    assert len(out) == 6 and out[1].json_type == "integer" and out[3].schema is None and "Foo" in out[4].error and out[5].default_value == "[1,2]" and out[6].default_value == "{1}"


def test_split_checks(spark):
    r = spark.createDataFrame([(1, "train", "x"), (2, "train", "y"), (2, "test", "y"), (3, None, "x"), (4, "train", "x")], "id long, split string, fingerprint string")
    assert [(d.id, d.split, d.owner) for d in quality.cross_split_duplicates(r).collect()] == [(2, "test", "train")]
    assert {(s.split, s.n, s.ids, s.shared_ids) for s in quality.split_report(r).collect()} == {("train", 3, 3, 1), ("test", 1, 1, 1)}
    with pytest.raises(ValueError, match="other splits"):
        quality.verify_splits(r, {"train": 3})
    with pytest.raises(ValueError, match="expected 2"):
        quality.verify_splits(r, {"train": 2})
    quality.verify_splits(r.where("id <> 2"), {"train": 2})
    other = r.where("id <> 4").union(r.where("id = 1"))
    assert {(m.id, m.n_left, m.n_right) for m in quality.id_mismatches(r, other).collect()} == {(1, 1, 2), (4, 1, 0)}
    assert quality.split_report(r.limit(0)).count() == 0


def test_scores_on_columns(spark):
    df = spark.createDataFrame([('{"name": "f", "arguments": {"a": 1}}', '[{"arguments": {"a": 1.0}, "name": "f"}]'), (None, "x")], "p string, e string")
    scoring.register(spark)
    rows = df.select(scoring.score_calls("p", "e").alias("s"), scoring.parse_calls("p").alias("c")).collect()
    assert rows[0].s.complete_call_match and not rows[1].s.valid_structure and rows[1]["c"]["errors"] == ["Model output is empty."]
    df.createOrReplaceTempView("outputs")
    texts = spark.createDataFrame([("<|im_start|>user\nhi<|im_end|>\n",), ("<|im_start|>x",), (None,)], "t string")
    texts.createOrReplaceTempView("texts")
    assert {(r.region, r.error) for r in spark.sql("SELECT s.* FROM texts, LATERAL loss_spans(t) s").collect()} == {("user_request", None), (None, "Malformed rendered chat block header.")}
    assert [tuple(r) for r in spark.sql("SELECT c.* FROM outputs, LATERAL parsed_calls(e) c").collect()] == [(0, "f", '{"a":1.0}')]
    assert spark.sql("SELECT score_calls(p, e).matched AS m FROM outputs WHERE p IS NOT NULL").first().m == 1


def test_every_document_is_parsed(spark, tmp_path):
    texts = ['{"status": "ok", "rows": 356}', "no calls here", None, '[{"name": "f", "arguments": {}}] ok', '{"name": "\\ud800", "arguments": {"a": "\\udfff"}}', '{"name": "f"}', "[" * 3000 + "]" * 3000]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.doc_id: (r.calls, r.valid_structure, r.errors, r.had_extra_prose) for r in queries.parse_calls(spark, str(tmp_path)).collect()}
    assert got == {0: (1, False, 2, False), 1: (0, False, 1, False), 2: (0, False, 1, False), 3: (1, True, 0, True), 4: (1, True, 0, False), 5: (1, False, 1, False), 6: (0, False, 0, False)}


def test_rendering_reports_faulty_records(spark, data):
    r = spark.read.parquet(f"{data}/canonical_records.parquet").limit(20)
    empty = r.limit(1).withColumns({"messages": F.lit(None).cast(r.schema["messages"].dataType), "record_no": F.lit(-1).cast("long")})
    checks = rendering.template_checks(r.unionByName(empty)).collect()
    assert len(checks) == 21 and [c.record_no for c in checks if c.error] == [-1]
    labels = rendering.token_labels(r)
    counts = rendering.mask_counts(labels).collect()
    assert len(counts) == 20 and all(c.included > 0 for c in counts)
    native = {s.record_no: s for s in rendering.sections(rendering.template_checks(r)).collect()}
    from callweave.functions import chat

    for c in checks[:20]:
        assert native[c.record_no].tool_section == chat.tagged_section(c.rendered_text)[0] and native[c.record_no].delimiters == chat.delimiters(c.rendered_text)


def test_files(spark, tmp_path, monkeypatch):
    raw = tmp_path / "raw.json"
    raw.write_text(json.dumps([{"id": 5, "query": "a", "tools": "[]", "answers": "[]"}, {"id": 6, "query": None}]))
    assert [(r.row_index, r.id, r.query) for r in files.read_raw_array(spark, str(raw)).collect()] == [(0, 5, "a"), (1, 6, None)]
    raw.write_text("{}")
    with pytest.raises(ValueError, match="no JSON array"):
        files.read_raw_array(spark, str(raw))
    (tmp_path / "many").mkdir()
    for name, ids in (("b", [7, 8]), ("a", [5, 6, 9]), ("c", [])):
        (tmp_path / "many" / f"{name}.json").write_text(json.dumps([{"id": i} for i in ids]))
    assert sorted((r.row_index, r.id) for r in files.read_raw_array(spark, str(tmp_path / "many")).collect()) == [(0, 5), (1, 6), (2, 9), (3, 7), (4, 8)]
    for s in ("train", "validation", "test"):
        (tmp_path / f"{s}.jsonl").write_text(f'{{"id": "{s}"}}\n\n  \n')
    got = files.read_splits(spark, str(tmp_path), "id string").collect()
    assert [(r.id, r.split) for r in got] == [(s, s) for s in ("train", "validation", "test")]
    with pytest.raises(ValueError, match="missing split files"):
        files.read_splits(spark, str(tmp_path / "none"), "id string")
    assert files.source_metadata(str(tmp_path / "about.json"), lambda: {"revision": "r1"}) == files.source_metadata(str(tmp_path / "about.json"), lambda: {"revision": "r2"}) == {"revision": "r1"}
    report = files.group_checksums(spark, {"raw": [str(tmp_path / "train.jsonl")]}).first()
    import hashlib

    text = (tmp_path / "train.jsonl").read_bytes()
    assert (report.group, report.bytes, report.line_count, report.sha256) == ("raw", len(text), 1, hashlib.sha256(text).hexdigest())
    (tmp_path / "big.txt").write_text("\n  \n" + "x" * 3_000_000 + "\nb\n \nlast")
    whole = [tuple(r) for r in files.file_checksums(spark, [str(tmp_path / "*.txt"), str(tmp_path / "many")]).orderBy("path").collect()]
    monkeypatch.setattr(files, "WHOLE_BYTES", 10)
    assert [tuple(r) for r in files.file_checksums(spark, [str(tmp_path / "*.txt"), str(tmp_path / "many")]).orderBy("path").collect()] == whole and len(whole) == 4 and whole[0][2] == 3
    with pytest.raises(FileNotFoundError):
        files.group_checksums(spark, {"raw": ["/nowhere"]})
    files.write_preview(spark.createDataFrame([(1, None)], "a int, b string"), str(tmp_path / "p"), ["a", "b"])
    assert [r.value for r in spark.read.text(str(tmp_path / "p")).collect()] == ["=" * 100, "a: 1", "b: null"]
    assert files.provenance([str(tmp_path / "train.jsonl")], "r1", licence="x")["files"][0]["sha256"] == report.sha256
    made = files.fetch_source(lambda revision: str(tmp_path / "train.jsonl"), lambda: {"revision": "r9", "license": "cc"}, str(tmp_path / "source.json"))
    assert made["revision"] == "r9" and made["license"] == "cc" and json.loads((tmp_path / "source.json").read_text()) == made
    (tmp_path / "cache" / "snapshots" / "abc").mkdir(parents=True)
    assert files.find_revision(str(tmp_path / "cache")) == "abc"
    (tmp_path / "cache" / "refs").mkdir()
    (tmp_path / "cache" / "refs" / "main").write_text("def\n")
    assert files.find_revision(str(tmp_path / "cache")) == "def"
    files.write_report({"b": 1, "a": "é"}, str(tmp_path / "r.json"))
    assert (tmp_path / "r.json").read_text() == '{\n  "a": "é",\n  "b": 1\n}\n'
    df = spark.createDataFrame([(2, "b"), (1, "a")], "row_index long, record string")
    assert files.write_records(df, str(tmp_path / "out")) == 0 and spark.read.text(str(tmp_path / "out")).count() == 2
    assert files.write_records(df.withColumn("record", F.lit(None).cast("string")), str(tmp_path / "out2")) == 2 and not (tmp_path / "out2").exists()


def test_streams_equal_batches(spark, data, tmp_path):
    schema = spark.read.parquet(f"{data}/raw_rows.parquet").schema
    (tmp_path / "in").mkdir()
    spark.read.parquet(f"{data}/raw_rows.parquet").write.mode("overwrite").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    for name, df, batch in (
        ("nodes", rowlocal.shredded_stream(stream), None),
        ("ready", rowlocal.prepared_stream(stream).select("row_index", "gate"), prepare.prepare(spark.read.parquet(f"{data}/raw_rows.parquet")).select("row_index", "gate")),
        ("once", rowlocal.distinct_stream(stream, ["id"]).select("id"), None),
        ("days", rowlocal.arrivals(stream), None),
    ):
        q = df.writeStream.format("memory").queryName(name).outputMode("append").start()
        q.processAllAvailable()
        q.stop()
        got = spark.table(name)
        if batch is not None:
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, batch.collect()), key=str)
    ids = spark.table("once").collect()
    assert len(ids) == len(set(ids)) and spark.table("nodes").count() > 0
