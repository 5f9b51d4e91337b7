import pytest

from lettermark.plans.workbench import QUERIES, Workbench

FOLDER = "/root/testdata/sf0.001"
NATIVE = ["windowed_impact", "citation_fields", "pair_counts", "self_cite_flag", "fuzzy_title_links", "author_profiles", "career_histories"]


def plan(spark, name):
    df = QUERIES[name](Workbench(spark, FOLDER))
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", NATIVE)
def test_no_products_and_no_python(spark, name):
    text = plan(spark, name)
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython", "ArrowEvalPython", "MapInPandas"):
        assert bad not in text


def test_scan_is_pruned(spark):
    text = plan(spark, "reference_counts")
    reads = [line for line in text.splitlines() if "FileScan" in line and "lineitem" in line]
    assert reads and all("l_extendedprice" not in line for line in reads)


def test_hand_off_folder_follows_the_session(spark):
    from lettermark.session import shared_folder

    assert shared_folder(spark) == shared_folder(spark)
