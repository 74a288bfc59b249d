import pytest
from sqlcheck import DATA, duck, same

from probtopk.jobs.oracles import ORACLES
from probtopk.jobs.queries import QUERIES


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_gives_the_rows_of_its_sql(spark, name):
    same(QUERIES[name](spark, DATA).toPandas(), duck(ORACLES[name]))


def test_entry_runs(spark):
    import __spark_entry__ as e

    rows = e.entry(spark).collect()
    assert len(rows) == 100 and [r["r"] for r in sorted(rows)] == list(range(1, 101))
    assert set(e.oracle_sql()) <= set(e.queries())
