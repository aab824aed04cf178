"""Every registered query with SQL equals it; the others give rows."""

import pytest
from oracle import duck, spark_rows

import __spark_entry__ as entry
from tidewatch.session import scratch

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_equals_sql(spark, name):
    with scratch(spark):
        assert spark_rows(entry.queries()[name](spark, SF)) == duck(SF, entry.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(entry.queries()) - set(entry.oracle_sql())))
def test_gives_rows(spark, name):
    with scratch(spark):
        assert entry.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert "anomaly_reason" in df.columns and df.count() > 0
