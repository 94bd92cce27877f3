"""Every catalogued query equals its SQL twin on the smallest tables."""

import pytest

import compare
from pagewright.plans.catalog import QUERIES
from pagewright.plans.oracle import oracles


def test_every_query_has_a_twin():
    assert set(oracles()) == set(QUERIES)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_twin(spark, sf_dir, name):
    report = compare.compare(spark, sf_dir, [name])
    assert report[name].startswith("ok"), report[name]
