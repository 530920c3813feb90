"""Queries against their SQL, on the smallest tables."""

import pytest

from sieveloom.llm.queries import ORACLES, QUERIES
from tests.compare import rows, same


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query(spark, sf, name):
    same(QUERIES[name](spark, sf), ORACLES[name], sf)


def test_ten_operators():
    assert sorted(int(k[2:].split("_")[0]) for k in QUERIES) == list(range(1, 11))


def test_same_at_every_run(spark, sf):
    for name in ("op5_toxicity", "op8_urls"):
        assert rows(QUERIES[name](spark, sf)) == rows(QUERIES[name](spark, sf))
