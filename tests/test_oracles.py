"""Every registered market query against its SQL."""

import pytest
from compare import rows_match

from marketlake.plans import registry


def test_all_have_sql():
    assert registry.QUERIES.keys() == registry.ORACLES.keys()


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_query(spark, sf, name):
    rows_match(spark, registry.QUERIES[name], registry.ORACLES[name], sf)
