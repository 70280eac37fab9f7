"""Every registered query of the engine against its DuckDB form."""

import pytest

from conftest import SF, same
from skein.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_oracle(spark, duck, name):
    same(catalog.QUERIES[name](spark, SF), duck, catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_flagship(spark):
    assert set(catalog.flagship(spark, SF).columns) == {"image_id", "other", "shared", "rank"}
