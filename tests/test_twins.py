"""Every query over the driver's tables against its SQL, and properties of the plans."""

import os

import pytest
from compare import SF, assert_same, connected

from codequarry.plans import code_twins, index_twins, twins

pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="needs the given tables")


@pytest.fixture(scope="module")
def con():
    return connected()


@pytest.mark.parametrize("name", sorted(twins.QUERIES))
def test_equals_its_sql(spark, con, name):
    assert_same(con, twins.QUERIES[name](spark, SF), twins.ORACLES[name])


def plan(spark, name):
    return twins.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(twins.QUERIES))
def test_no_cartesian_product(spark, name):
    assert "CartesianProduct" not in plan(spark, name)


def test_plans_are_the_ones_we_want(spark):
    for name in ("keyset_page", "ranked_topk", "autocomplete", "bm25_topk"):
        assert "TakeOrderedAndProject" in plan(spark, name), name
    assert "PushedFilters: [IsNotNull(" in plan(spark, "cmp_filter") and "ReadSchema" in plan(spark, "cmp_filter")
    joined = plan(spark, "containment_join")
    assert "user_id" in joined and "NestedLoop" not in joined and "Python" not in joined
    structural = plan(spark, "structural_contains")
    assert structural.count("MapInArrow") == 1 and structural.index("MapInArrow") < structural.index("array_contains")
    assert code_twins.query is index_twins.query is twins.query
