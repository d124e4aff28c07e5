from __future__ import annotations

import pytest
from meterlark.plans import catalog
from oracle import compare


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_and_sql_agree(spark, name):
    rows = compare(spark, catalog.QUERIES[name], catalog.ORACLES[name])
    assert rows > 0
