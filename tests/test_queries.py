import pytest

from orrery.plans import catalogue
from oracle import SF, compare, connect


@pytest.mark.parametrize("name", sorted(catalogue.queries()))
def test_query_against_oracle(spark, name):
    df = catalogue.queries()[name](spark, SF)
    sql = catalogue.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
        return
    ours, theirs = compare(df, connect(), sql)
    assert ours == theirs
