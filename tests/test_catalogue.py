import os

import pytest
from oracle import compare

from tablarium.plans import catalogue, dialogue, experiments, fields, pages  # noqa: F401

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.mark.parametrize("name", list(catalogue.QUERIES))
def test_query_matches_sql(spark, name):
    compare(spark, catalogue.QUERIES[name], catalogue.ORACLES[name], SF)
