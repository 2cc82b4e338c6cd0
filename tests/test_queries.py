import pytest
from oracle import compare

from veilmark import registry

ROWS_ONLY = sorted(set(registry.queries()) - set(registry.oracle_sql()))


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows_as_sql(spark, sf, name):
    compare(registry.queries()[name](spark, sf), registry.oracle_sql()[name], sf)


@pytest.mark.parametrize("name", ["html_nodes", "plan_message", "gate_violations"])
def test_runs(spark, sf, name):
    assert name in ROWS_ONLY
    assert registry.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
