"""Every query of the catalogue against its SQL, at two sizes."""

import pytest

from folioscan.plans.queries import CATALOGUE
from tests.oracle import compare, connect


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(CATALOGUE))
def test_query(spark, name, sf):
    plan, sql = CATALOGUE[name]
    compare(plan(spark, f"/root/testdata/{sf}"), connect(f"/root/testdata/{sf}"), sql)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())
