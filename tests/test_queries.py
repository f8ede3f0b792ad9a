import os

import pytest

from basaltiq.registry import load_core
from tests.oracle import same

CORE = load_core()
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
LARGER = "/root/testdata/sf0.01"


@pytest.mark.parametrize("name", sorted(CORE.sql))
def test_agrees_with_sql(spark, name):
    """Equal rows, and some: where the smallest tables give none, the next ones must."""
    assert same(CORE.builders[name](spark, SF), CORE.sql[name], SF) or same(CORE.builders[name](spark, LARGER), CORE.sql[name], LARGER)


@pytest.mark.parametrize("name", sorted(set(CORE.builders) - set(CORE.sql)))
def test_runs(spark, name):
    assert CORE.builders[name](spark, SF).count() > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
