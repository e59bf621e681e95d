"""Plan shape of every catalogue query: no cartesian or nested-loop joins, pruned
scans, partial aggregation before the shuffle for the cell statistics."""

import re

import pytest

import __spark_entry__ as E
from runlens.plans.catalogue import QUERIES

from .conftest import SF_SMALL

def _plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_no_cartesian_or_nested_loop(spark, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_cell_stats_partial_aggregation_and_pruning(spark):
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = _plan(E.queries()["cell_stats"](spark, SF_SMALL))
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert "partial_count" in plan and "partial_var_samp" in plan
    # only the used event columns are read (the timestamp is pruned)
    read = [c.split(":")[0] for c in plan.split("ReadSchema: struct<")[1].split(">")[0].split(",")]
    assert sorted(read) == ["event_id", "event_type", "props", "user_id", "value"]


# Scans and joins of plans in which nothing is broadcast, as on tables too large for it.
STATIC = {
    "bleu_acc": (3, 1), "rouge1_acc": (3, 1), "response_parse": (1, 0), "prompt_build": (3, 1), "budget_states": (1, 0),
    "budget_transitions": (1, 0), "warmup_filter": (2, 1), "cell_runs_padded": (2, 1), "stat_audit": (2, 1), "rescore_summary": (4, 3),
}


@pytest.fixture
def without_broadcasts(spark):
    confs = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    old = {k: spark.conf.get(k) for k in confs}
    for k, v in confs.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("name", sorted(STATIC))
def test_scans_and_joins_without_broadcasts(spark, without_broadcasts, name):
    plan = _plan(E.queries()[name](spark, SF_SMALL))
    joins = plan.count("SortMergeJoin") + plan.count("ShuffledHashJoin")
    assert (plan.count("FileScan"), joins) == STATIC[name] and "Broadcast" not in plan


def _exchange_keys(plan):
    return [re.sub(r"#\d+L?", "", k) for k in re.findall(r"Exchange hashpartitioning\(([^\n]*), \d+\), ENSURE", plan)]


def test_overlap_scores_shuffle_no_grams(spark, without_broadcasts):
    for name in ("bleu_acc", "rouge1_acc"):
        assert set(_exchange_keys(_plan(E.queries()[name](spark, SF_SMALL)))) == {"doc_id", "item_id"}


def test_prompt_parts_are_made_before_the_shuffle(spark, without_broadcasts):
    plan = _plan(E.queries()["prompt_build"](spark, SF_SMALL))
    # what stands under each exchange already holds the digests, so texts stay where they are
    below = re.findall(r"Exchange hashpartitioning\(item_id[^\n]*\n[^\n]* Project \[.*?AS (payload_md5|prompt_md5)#", plan, re.DOTALL)
    assert sorted(below) == ["payload_md5", "prompt_md5"]
