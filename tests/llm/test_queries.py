"""Queries of the subpackage against their SQL."""

import pytest

from folioscan.llm.queries import ORACLES, QUERIES
from tests.oracle import compare, connect


@pytest.mark.parametrize("sf", ["sf0.001", "sf0.01"])
@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, name, sf):
    compare(QUERIES[name](spark, f"/root/testdata/{sf}"), connect(f"/root/testdata/{sf}"), ORACLES[name])
