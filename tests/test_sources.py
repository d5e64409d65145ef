import hashlib
import json

import pytest

from callweave.sources import files


def test_checksums_hold_no_whole_file(spark, tmp_path, monkeypatch):
    """a file's bytes never become a value of a row, and each way of reading gives the same."""
    text = b"\n \t\r\n" + b"x" * 3_000_000 + b"\r\n\r\nb\n\x00\xff\n \nlast"
    (tmp_path / "a b.txt").write_bytes(text)
    (tmp_path / "empty.txt").write_bytes(b"")
    made = files.file_checksums(spark, [str(tmp_path)])
    assert "ReadSchema: struct<path:string>" in made._jdf.queryExecution().executedPlan().toString()
    want = [(f"file:{tmp_path}/a b.txt", len(text), 4, hashlib.sha256(text).hexdigest()), (f"file:{tmp_path}/empty.txt", 0, 0, hashlib.sha256(b"").hexdigest())]
    assert [tuple(r) for r in made.orderBy("path").collect()] == want
    monkeypatch.setattr(files, "_local", lambda path: False)
    for bound in (1 << 24, 10):
        monkeypatch.setattr(files, "WHOLE_BYTES", bound)
        assert [tuple(r) for r in files.file_checksums(spark, [str(tmp_path)]).orderBy("path").collect()] == want


def _arrays():
    """(name, text) of arrays in several layouts; a split of a few hundred bytes begins in strings, keys, nested values and between elements."""
    tricky = ['}{],["\\', "\\\\", '\\"}', "é} ", "", '"}]', "a" * 3_000 + "}" * 50]
    rows = [{"id": i, "query": tricky[i % 7], "tools": json.dumps([{"a": {"b": [tricky[(i + 3) % 7]]}}] * (i % 4)), "more": {"x": [{"y": "}"}, []], "z": {}}, "answers": None} for i in range(24)]
    return rows, {
        "plain": json.dumps(rows), "spaced": "\n \t" + json.dumps(rows, indent=3, ensure_ascii=False) + " \n\n", "lines": "[\n" + "\n,".join(json.dumps(r, separators=(",", ":")) for r in rows) + "]"
    }


def test_arrays_are_read_in_splits(spark, tmp_path):
    """no task gets a file as one value, wherever the splits fall; rows and places are those of a JSON decoder."""
    rows, texts = _arrays()
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    want = [(i, r["id"], r["query"], r["tools"], None) for i, r in enumerate(rows)]
    try:
        for size in ("500", "6000", "128m"):
            for k in before:
                spark.conf.set(k, size)
            for name, text in texts.items():
                (tmp_path / f"{name}.json").write_text(text, encoding="utf-8")
                got = files.read_raw_array(spark, str(tmp_path / f"{name}.json"))
                assert sorted(tuple(r) for r in got.collect()) == want, (size, name)
                assert size != "500" or got.rdd.getNumPartitions() > 10
        for k in before:
            spark.conf.set(k, "2000")
        (tmp_path / "many").mkdir()
        for name, part in (("b", rows[9:]), ("a", rows[:9]), ("0", [])):
            (tmp_path / "many" / f"{name}.json").write_text(json.dumps(part))
        assert sorted(tuple(r) for r in files.read_raw_array(spark, str(tmp_path / "many")).collect()) == want
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_arrays_of_odd_values(spark, tmp_path):
    path = tmp_path / "raw.json"
    for text, want in (("[]", []), (" [ \n] ", []), ('[null, {"id": 5}, {}]', [(0, None), (1, 5), (2, None)]), ("[null]", [(0, None)])):
        path.write_text(text)
        assert sorted((r.row_index, r.id) for r in files.read_raw_array(spark, str(path)).collect()) == want, text
    good = '{"id": 5}'
    for text in ("", " ", "5", f"[{good}", f"{good}]", f"[{good},]", f"[,{good}]", f"[{good} {good}]", f"[{good}] x", f"[{good}], [{good}]", f'[{good}, {{"id": }}]', f'["{good}]', f"[{good}]]", f"x[{good}]", f"[{good[:-1]}]", f"[{good},,{good}]", f"[{good}]}}\n"):
        path.write_text(text)
        with pytest.raises(ValueError, match="no JSON array"):
            files.read_raw_array(spark, str(path))
    path.write_text("[5]")
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|malformed"):
        files.read_raw_array(spark, str(path)).collect()


def test_arrays_are_written_in_order(spark, tmp_path):
    """one array in one file whatever the number of tasks that made it, also of equal and of no rows."""
    schema = "row_index long, id long, query string, tools string, answers string"
    rows = [(i * 7 % 100, i, 'q"\n,[', None, "é") for i in range(100)]
    for own in (rows, [rows[0], rows[0]], []):
        files.write_raw_array(spark.createDataFrame(own, schema).repartition(5), path := str(tmp_path / "array"))
        files_there = [f for f in (tmp_path / "array").iterdir() if not f.name.startswith(("_", "."))]
        assert len(files_there) == 1
        want = [dict(zip(("id", "query", "tools", "answers"), r[1:], strict=True)) for r in sorted(own)]
        assert json.loads(files_there[0].read_text(encoding="utf-8")) == want
        assert [(r.row_index, r.id) for r in files.read_raw_array(spark, path).orderBy("row_index").collect()] == [(i, w["id"]) for i, w in enumerate(want)]
    assert not any(f.name in ("_parts", "_array") for f in (tmp_path / "array").iterdir())
