import os

import pytest

from sheafline.llm import queries

SMALL = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SMALL), reason="test tables are not here")
@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_runs_over_small_tables(spark, name):
    rows = queries.queries()[name](spark, SMALL).collect()
    assert rows
    if name.endswith("_found"):
        assert len(set(rows)) == len(rows)
