import json
import random

import numpy as np
import pytest

from callweave.llm import near_duplicates as m
from callweave.llm.components import components
from callweave.llm.words import distinct_words, word_hash

SCHEMA = "row_index long, query string, tools string, key string, rep long"


def table(spark, rows):
    return spark.createDataFrame([(i, q, t, "clash", 7) for i, (q, t) in enumerate(rows)], SCHEMA)


def brute(rows):
    sets = [(set(distinct_words(q)), set(m.tool_names(t) or [])) for q, t in rows]
    out = set()
    for j, (w, n) in enumerate(sets):
        for i in range(j):
            v, k = sets[i]
            if w and v and n and k and 10 * len(w & v) >= 7 * len(w | v) and 2 * len(n & k) >= len(n | k):
                out.add((i, j))
    return out


def tools(*names):
    return json.dumps([{"name": n} if i % 2 else {"type": "function", "function": {"name": f" {n} "}} for i, n in enumerate(names)])


def some_rows(n=160, seed=3):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    rows = []
    for _ in range(n):
        if rows and rng.random() < 0.6:
            words = rng.choice(rows)[0].split()
            for _ in range(rng.randint(0, 6)):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            rng.shuffle(words)
        else:
            words = rng.sample(vocabulary, rng.randint(15, 40))
        rows.append((" ".join(words), tools(*rng.sample("abcd", rng.randint(1, 3)))))
    return rows


ODD = [(None, tools("a")), ("q w", None), ("q w", "["), ("q w", "{}"), ("q w", "[1, null]"), ("", tools("a")), ("ß !", tools("a")), ("x " * 300_000 + "y", tools("a")), ("y X", tools("a")), ("q", tools("a", "b")), ("Q", tools("b", "a")), ("q", tools("c"))]


@pytest.mark.parametrize(("hot", "base"), [(500, 1_000_000), (2, 2)])
def test_pairs_equal_brute_force(spark, monkeypatch, hot, base):
    monkeypatch.setattr(m, "HOT", hot)
    monkeypatch.setattr(m, "BASE_ROWS", base)  # so small a base makes bands of nine minima
    monkeypatch.setattr("callweave.session.HOT_ROWS", hot)
    monkeypatch.setattr("callweave.llm.expand.BLOCK_ROWS", hot)
    rows = some_rows() + ODD + some_rows(20)[:5] * 3
    got = [(r.row_a, r.row_b) for r in m.found(table(spark, rows)).collect()]
    want = brute(rows)
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(set(got)) >= 0.99 * len(want)


def test_groups_hold_every_row_once(spark):
    rows = some_rows() + ODD + [("same words here", tools("a"))] * 40
    pairs = brute(rows)
    out = {r.row_index: r for r in m.groups(table(spark, rows)).collect()}
    assert all(out[a].group_id == out[b].group_id for a, b in m_pairs(spark, rows)) and {a for p in pairs for a in p} <= set(out)
    copies = [out[i] for i in range(len(rows) - 40, len(rows))]
    assert len({c.class_id for c in copies}) == 1 and copies[0].links == 0


def m_pairs(spark, rows):
    return [(r.row_a, r.row_b) for r in m.found(table(spark, rows)).collect()]


def test_bands_grow_with_the_collection_and_miss_no_more():
    schemes = [m.scheme_for(10**k) for k in range(0, 13)]
    assert (schemes[0].rows, schemes[0].bands, schemes[0].n) == (6, 48, 288) and m.scheme_for(4_000_000).rows == 7
    assert all(a.rows <= b.rows for a, b in zip(schemes, schemes[1:])) and schemes[-1].rows == 15
    for s in schemes:
        assert s.missed(0.7) <= m.MISS and s.missed(0.75) < 1e-4 and s.missed(0.8) < 1e-6 and s.n % 8 == 0 and s.n >= s.rows * s.bands


def test_empty_table(spark):
    assert m.found(table(spark, [("a", "b")]).limit(0)).count() == 0 and m.groups(table(spark, [("a", "b")]).limit(0)).count() == 0


def test_estimate_follows_similarity(spark):
    rng = np.random.default_rng(1)
    words = np.array([word_hash(f"v{i}") for i in range(900)], np.int64)
    rows = []
    for k in (0, 150, 300, 450, 600):
        a, b = words[:600], np.concatenate((words[:k], words[300 : 900 - k]))
        rows.append((k, [int(x) for x in m.signature(a, 288)], [int(x) for x in m.signature(rng.permutation(b), 288)], len(set(a) & set(b)) / len(set(a) | set(b))))
    out = spark.createDataFrame(rows, "k int, a array<long>, b array<long>, s double").withColumn("e", m.estimate(*map(lambda c: m.F.col(c), "ab"))).collect()
    assert all(abs(r.e - r.s) < 4.5 * 0.5 / 288**0.5 for r in out)
    assert out[-1].e == 1.0


def test_components(spark):
    chain = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (7, 7)]
    out = {r.node: r.component for r in components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert {out[i] for i in range(41)} == {0} and out[102] == out[101] == 100
