import json
import random

import numpy as np
import pytest

from callweave.llm import overlap as m
from callweave.llm.fulltext import Index, suffix_array
from callweave.llm.words import distinct_words

CALL = "struct<id: string, type: string, function: struct<name: string, arguments: string>>"
SCHEMA = f"record_no long, messages array<struct<role: string, content: string, tool_calls: array<{CALL}>>>, metadata struct<source_dataset: string, split: string>, split string, side string, cls long"


def record(no, split, text, calls, source="s"):
    made = [("c", "function", (n, a if isinstance(a, str) or a is None else json.dumps(a))) for n, a in calls]
    return (no, [("user", text, None), ("assistant", "", made)], (source, split), "clash", "clash", 1)


def brute(rows):
    sides = {"train": [], "eval": []}
    for no, messages, meta, *_ in rows:
        split = (meta[1] or "").strip().lower() if meta else ""
        plain = [{"role": r, "content": c, "tool_calls": [{"function": {"name": f[0], "arguments": f[1]}} for _, _, f in t or []]} for r, c, t in messages or []]
        words, key = set(distinct_words(m.first_user(plain))), m.calls_key(plain)
        if words and key is not None and split in ("train", "validation", "test"):
            sides["train" if split == "train" else "eval"].append((no, words, key))
    return {(min(a, b), max(a, b)) for a, w, k in sides["train"] for b, v, h in sides["eval"] if k == h and 10 * len(w & v) >= 7 * len(w | v)}


def some_records(n=220, seed=2, keys=4):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)]
    texts, rows = [], []
    for no in range(n):
        if texts and rng.random() < 0.7:
            words = rng.choice(texts).split()
            for _ in range(rng.randint(0, 3)):
                words.insert(rng.randrange(len(words) + 1), rng.choice(vocabulary))
            if rng.random() < 0.3:
                rng.shuffle(words)
        else:
            words = rng.sample(vocabulary, rng.randint(1, 15))
        texts.append(" ".join(words))
        calls = [("f", {"k": rng.randrange(keys), "b": [1, {"x": None}]}), ("g", "{}")]
        rng.shuffle(calls)
        rows.append(record(no, rng.choice(["train", " Train", "TEST", "validation", None, "other"]), texts[-1], calls))
    return rows


@pytest.mark.parametrize(("shard", "chunk", "keys"), [(8_000, 16_000, 4), (10, 7, 1)])
def test_pairs_equal_brute_force(spark, monkeypatch, shard, chunk, keys):
    monkeypatch.setattr(m, "SHARD_ROWS", shard)
    monkeypatch.setattr(m, "CHUNK_ROWS", chunk)
    monkeypatch.setattr(m, "PAIRS", shard // 2)
    monkeypatch.setattr(m, "PLACES", 10 * shard)
    rows = some_records(keys=keys)
    got = [(r.record_a, r.record_b) for r in m.found(spark.createDataFrame(rows, SCHEMA)).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(rows)


def test_odd_records(spark):
    long = "word " * 50_000 + "end"
    f = [("f", {"a": 1})]
    rows = [
        record(0, "train", long, f), record(1, "test", "END word", [("f", '{"a": 1.0}')]), record(2, "test", None, f), record(3, "train", "", f), record(4, "test", "end word", [("f", "{")]),
        record(5, "train", "p q", []), record(6, "test", "q P", [("f", None)]), record(7, "validation", "q P", []), (8, None, ("s", "train"), "", "", 1), (9, [("user", "p q", None)], None, "", "", 1), record(10, "test", "end word", [("f", {"a": True})]),
    ]
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.record_a, r.record_b) for r in m.found(df).collect()} == {(0, 1), (5, 7)}
    rep = {(r.split, r.pairs, r.exact_pairs, r.eval_records) for r in m.report(df).collect()}
    assert rep == {("test", 1, 1, 1), ("validation", 1, 1, 1)}
    assert m.found(df.limit(0)).count() == 0 and m.report(df.where("record_no = 0")).count() == 0


def test_report_counts_pairs(spark):
    rows = some_records(120)
    pairs = brute(rows)
    out = m.report(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sum(r.pairs for r in out) == len(pairs)
    evals = {x for p in pairs for x in p if (rows[x][2][1] or "").strip().lower() in ("validation", "test")}
    assert sum(r.eval_records for r in out) == len(evals)


def test_index_counts_and_locates():
    rng = np.random.default_rng(4)
    docs = [rng.integers(-5, 5, n).astype(np.int64) for n in (7, 1, 30, 12, 0, 5)]
    index = Index.load(Index.build(docs).dump())
    for n in (1, 2, 3):
        for _ in range(40):
            pattern = rng.integers(-6, 5, n).astype(np.int64)
            s = index.symbols(pattern)
            lo, hi = index.interval(s[-1:])
            for c in s[-2::-1]:
                lo, hi = index.step(np.array([c]), lo, hi)
            d, o = index.documents(index.locate(np.arange(int(lo[0]), int(hi[0]))))
            want = {(i, j) for i, x in enumerate(docs) for j in range(len(x) - n + 1) if (x[j : j + n] == pattern).all()}
            assert set(zip(d.tolist(), o.tolist())) == want
    text = rng.integers(0, 3, 200)
    assert suffix_array(text).tolist() == sorted(range(200), key=lambda i: text[i:].tolist())


def test_spans_are_maximal_matches():
    index = Index.build([np.array([1, 2, 3, 5, 6, 9], np.int64), np.array([4], np.int64), np.array([1, 2, 3, 4, 5, 6], np.int64)])
    out = {r.eval_cls: r for r in m.stream(index, np.array([77, 78, 79]), np.array([5]), [np.array([1, 2, 3, 4, 5, 6], np.int64)]).itertuples()}
    assert {k: (r.common, r.spans, r.longest) for k, r in out.items()} == {77: (5, 2, 3), 79: (6, 1, 6)}
    assert list(m.stream(index, np.array([77, 78, 79]), np.array([5]), [np.array([4], np.int64)]).eval_cls) == [78]


def test_matches_come_from_backward_search(spark, monkeypatch):
    rng = np.random.default_rng(1)
    docs = [np.sort(rng.choice(60, 12, replace=False)).astype(np.int64) for _ in range(50)]
    ids, index = np.arange(50), Index.build(docs)
    whole = m.stream(index, ids, ids, docs)
    assert set(zip(ids, ids)) <= set(zip(whole.train_cls, whole.eval_cls))
    monkeypatch.setattr(Index, "step", lambda self, symbol, lo, hi: (lo, lo))
    assert not len(m.stream(index, ids, ids, docs))
    monkeypatch.undo()
    monkeypatch.setattr(Index, "back", lambda self, rows: rows)
    assert len(m.stream(index, ids, ids, docs)) < len(whole)


@pytest.mark.parametrize("n", range(1, 40))
def test_no_more_pairs_break_than_said(n):
    sizes = [(a, b) for a in range(n) for b in range(2 * n) if 10 * (n - a) >= 7 * (n + b)]
    assert m.most_broken(n) == max(2 * a + b for a, b in sizes) < n + 1
    assert all(m.least_common(np.array(n), np.array(n - a + b)) <= n - a for a, b in sizes)


def test_rows_of_large_classes_meet_in_blocks(spark, monkeypatch):
    from callweave.llm import expand

    monkeypatch.setattr(expand, "BLOCK_ROWS", 4)
    rows = spark.createDataFrame([(1, i) for i in range(30)] + [(2, 100), (3, 101)], "a long, row_x long")
    links = spark.createDataFrame([(1, 1), (1, 2), (3, 3)], "a long, b long")
    got = sorted(map(tuple, expand.row_pairs(links, rows, rows.toDF("b", "row_y"), expand.class_sizes(rows, "a"), expand.class_sizes(rows.toDF("b", "row_y"), "b")).collect()))
    assert got == sorted([(i, j) for i in range(30) for j in range(30)] + [(i, 100) for i in range(30)] + [(101, 101)])
