from __future__ import annotations

import pytest

from __spark_entry__ import entry
from archidex.plans.oracles import ORACLES
from archidex.plans.registry import QUERIES
from tests.check_oracles import connect, differences

SF = "/root/testdata/sf0.001"
# The smallest tables hold nothing that these find.
LARGER = "/root/testdata/sf0.01"
NEED_MORE_ROWS = {"duplicates_drive", "search", "search_index"}


def test_every_query_has_its_sql():
    assert set(QUERIES) == set(ORACLES)


def test_entry(spark):
    assert entry(spark).columns == ["hash", "size", "copies", "drive_id", "drive_name", "path"]


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_equals_sql(spark, name):
    sf_dir = LARGER if name in NEED_MORE_ROWS else SF
    assert differences(spark, connect(sf_dir), sf_dir, QUERIES[name], ORACLES[name]) is None
