import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
import oracle  # noqa: E402

from prismal.llm import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    return oracle.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query(spark, con, name):
    oracle.check(spark, con, SF, registry.QUERIES[name], registry.ORACLES[name])


def test_every_operator_has_a_query():
    assert {n.split("_")[0] for n in registry.QUERIES} == {f"op{i}" for i in range(1, 11)} | {"pipeline"}
