"""Every registered query against its SQL, on the smallest tables."""

import pytest
from compare import same

from strandlake.plans import files  # noqa: F401 - registers its queries
from strandlake.plans import queries as plans


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_matches_sql(spark, sf, duck, name):
    same(plans.QUERIES[name](spark, sf), duck.execute(plans.SQL[name]))


@pytest.mark.parametrize("name", sorted(set(plans.QUERIES) - set(plans.SQL)))
def test_query_without_sql_has_rows(spark, sf, name):
    assert plans.QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 499
    assert set(e.oracle_sql()) <= set(e.queries())
