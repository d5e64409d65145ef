import pytest

from callweave.llm.oracles import SQL
from callweave.llm.queries import QUERIES
from tests.test_queries import compare


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, data, name):
    if name in SQL:
        compare(spark, data, QUERIES[name], SQL[name])
    else:
        df = QUERIES[name](spark, data)
        assert len(df.columns) == len(set(df.columns))
        df.count()
