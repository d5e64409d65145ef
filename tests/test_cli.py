import json

import pytest

from callweave.__main__ import main
from callweave.functions import chat
from callweave.operators import evaluation, prepare, selection
from callweave.sources import files

TOOL = json.dumps([{"name": "t", "description": "d", "parameters": {"a": {"type": "str", "description": "d"}}}])


def answers(n, value="x"):
    return json.dumps([{"name": "t", "arguments": {"a": value}}] * n)


def test_commands(spark, data, tmp_path):
    raw = tmp_path / "raw.json"
    tool = json.dumps([{"name": "t", "parameters": {"a": {"type": "str"}}}])
    raw.write_text(json.dumps([{"id": 1, "query": "q", "tools": tool, "answers": '[{"name": "t"}]'}]))
    run = lambda *a: main([*a, "--output", str(tmp_path / a[0])], spark)
    assert run("prepare", "--input", str(raw)) == 0
    record = json.loads(spark.read.text(str(tmp_path / "prepare")).first()[0])
    assert record["messages"][1]["tool_calls"][0]["function"] == {"name": "t", "arguments": {}}
    assert run("validate", "--input", str(raw), "--context-token-limit", "1") == 0
    assert [i.category for i in spark.read.parquet(str(tmp_path / "validate")).first().issues] == ["context_length_exceeded"]
    assert run("inspect", "--input", str(raw)) == 0
    assert json.loads((tmp_path / "inspect" / "profile.json").read_text())["fault"] == {"none": 1} and "query: q" in [r.value for r in spark.read.text(str(tmp_path / "inspect" / "preview")).collect()]
    raw.write_text(json.dumps([{"id": 1, "query": "q", "tools": "x", "answers": "[]"}]))
    assert main(["prepare", "--input", str(raw), "--output", str(tmp_path / "none")], spark) == 1 and not (tmp_path / "none").exists()
    records = f"{data}/canonical_records.parquet"
    assert run("template", "--input", records, "--count", "5") == 0
    report = json.loads(spark.read.parquet(str(tmp_path / "template")).orderBy("record_no").first().report)
    assert spark.read.parquet(str(tmp_path / "template")).count() == 5 and report["checks"]["failures"] == [] and report["tool_section_tags"] == ["<tools>", "</tools>"] and report["thinking_mode_supported"]
    assert report["expected_calls"] == report["rendered_calls"] and report["feature_tags"] and report["rendered_text"] == report["decoded_text"]
    assert main(["template", "--input", records, "--output", str(tmp_path / "odd"), "--tokenizer", "tests.test_cli:Thinking", "--count", "1"], spark) == 1
    assert main(["template", "--input", records, "--output", str(tmp_path / "odd"), "--tokenizer", "tests.test_cli:Thinking", "--count", "1", "--enable-thinking", "--revision", "r"], spark) == 0
    assert run("loss-mask", "--input", records, "--count", "2", "--pad-to", "5000") == 0
    counts = {r[0]: r[1] for r in spark.read.parquet(str(tmp_path / "loss-mask")).groupBy("record_no").count().collect()}
    assert list(counts.values()) == [5000, 5000]
    assert run("checksums", "--input", str(raw)) == 0 and spark.read.json(str(tmp_path / "checksums")).count() == 1


class Thinking(chat.ChatMarkup):
    def __init__(self, revision=None):
        super().__init__()

    def apply_chat_template(self, messages, tools=None, tokenize=False, **kwargs):
        text = super().apply_chat_template(messages, tools) + "<think>so</think>"
        return [t for t, _, _ in self.encode(text)] if tokenize else text


def test_select_repair_and_verify(spark, tmp_path):
    rows, n = [], 0
    for start in (0, 33_659):
        for k, need in ((1, 62), (2, 27), (3, 17)):
            for _ in range(need):
                rows.append((n, start + n, f"ask {n}", TOOL, answers(k)))
                n += 1
    columns = "row_index long, id long, query string, tools string, answers string"
    spark.createDataFrame(rows, columns).write.parquet(str(tmp_path / "raw"))
    run = lambda *a: main([*a, "--input", str(tmp_path / "raw")], spark)
    assert run("select", "--output", str(tmp_path / "s")) == 0
    manifest = json.loads((tmp_path / "s" / "manifest.json").read_text())
    assert len(manifest["records"]) == 200 and "fingerprint" not in manifest["records"][0] and json.loads((tmp_path / "s" / "summary.json").read_text())["split"] == {"train": 120, "validation": 40, "test": 40}
    lines = [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "s" / "test.jsonl")).collect()]
    assert lines == [r["id"] for r in manifest["records"] if r["split"] == "test"]
    # one selected row turns faulty: its call no longer fits
    spark.createDataFrame([(*r[:4], answers(len(json.loads(r[4])), 5)) if r[1] == lines[0] else r for r in rows], columns).write.mode("overwrite").parquet(str(tmp_path / "raw"))
    assert run("repair", "--selected", str(tmp_path / "s"), "--output", str(tmp_path / "t")) == 0
    report = json.loads((tmp_path / "t" / "validation.json").read_text())
    assert report["rejected_examples"] == 1 and report["replacements"][0]["rejected_source_id"] == lines[0] and report["final_total_examples"] == 200
    again = [json.loads(r.value)["id"] for r in spark.read.text(str(tmp_path / "t" / "test.jsonl")).collect()]
    assert again[1:] == lines[1:] and again[0] == report["replacements"][0]["replacement_source_id"]
    # the manifest alone leads to the same selection, and without it one is made anew
    pool = prepare.candidates(prepare.prepare(spark.read.parquet(str(tmp_path / "raw"))))
    ids = lambda df: [(r.split, r.pos, r.id) for r in df.orderBy("split", "pos").collect()]
    by_files = ids(evaluation.load_selected(spark, str(tmp_path / "t"), "none", pool))
    assert by_files == ids(evaluation.load_selected(spark, str(tmp_path / "none"), str(tmp_path / "t" / "manifest.json"), pool))
    assert ids(evaluation.load_selected(spark, str(tmp_path / "none"), str(tmp_path / "none.json"), pool)) == ids(selection.select(pool))
    (tmp_path / "bad.json").write_text('{"records": [{"split": "other", "id": 1}]}')
    with pytest.raises(ValueError, match="Unexpected split"):
        evaluation.load_selected(spark, str(tmp_path / "none"), str(tmp_path / "bad.json"), pool)
    # normalized files hold the same ids
    source, records = prepare.load_records(spark, str(tmp_path / "none"), str(tmp_path / "t"))
    assert source == "raw" and records.count() == 200
    for split in selection.SPLITS:
        files.write_json_lines(records.where(f"split = '{split}'"), str(tmp_path / "n" / f"{split}.jsonl"), "record", "source_id")
    assert prepare.load_records(spark, str(tmp_path / "n"), str(tmp_path / "t"))[0] == "normalized"
    assert [r.id for r in prepare.load_records(spark, str(tmp_path / "n"), "none")[1].collect()] == [r.id for r in records.collect()]
    with pytest.raises(FileNotFoundError):
        prepare.load_records(spark, str(tmp_path / "none"), str(tmp_path / "none"))
    verify = lambda sizes: main(["verify", "--input", str(tmp_path / "t"), "--normalized", str(tmp_path / "n"), "--sizes", sizes, "--output", str(tmp_path / "v.json")], spark)
    assert verify("120,40,40") == 0 and json.loads((tmp_path / "v.json").read_text())["raw_and_normalized_ids_match"]
    with pytest.raises(ValueError, match="expected 39"):
        verify("120,40,39")
