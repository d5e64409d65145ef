"""Every core query runs over the smallest tables, and equals its SQL where it has one."""

import glob
import math
import os

import duckdb
import pytest

from callweave.plans.queries import QUERIES, SQL


def connect(folder):
    c = duckdb.connect()
    c.execute("SET TimeZone = 'UTC'")
    for p in glob.glob(f"{folder}/*.parquet"):
        c.execute(f"CREATE VIEW {os.path.basename(p)[:-8]} AS SELECT * FROM '{p}'")
    return c


def canonical(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    value = lambda v: None if v is None or (isinstance(v, float) and math.isnan(v)) else f"{v:.9g}" if isinstance(v, float) else str(v)
    return sorted((tuple(value(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, folder, query, sql):
    df = query(spark, folder)
    rel = connect(folder).sql(sql)
    assert sorted(df.columns) == sorted(rel.columns)
    assert canonical(df.collect(), df.columns) == canonical(rel.fetchall(), rel.columns)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        compare(spark, data, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, data)
        assert len(df.columns) == len(set(df.columns))
        df.count()
