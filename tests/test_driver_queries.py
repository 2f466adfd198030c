import os

import pytest
from oracle import compare

from weftline.plans import driver

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not here")
@pytest.mark.parametrize("name", list(driver.queries()))
def test_query_matches_its_sql(spark, name):
    compare(spark, driver.queries()[name], driver.oracle_sql()[name], SF)


def test_entry_runs(spark):
    import __spark_entry__

    assert set(driver.queries()) <= set(__spark_entry__.queries())
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
