"""Re-scoring, pass@k and sampling (FIXTURES.md 3.4)."""

import pytest
from pyspark.sql import functions as F

from runlens.operators import compare as CMP
from runlens.operators import triage as TR


def test_rescore_counts(spark):
    s = spark.createDataFrame([("m", i, p) for i, p in enumerate([0.0, 0.0, 1.0, 1.0])],
                              "model string, doc_id long, pass_at_1 double")
    o = spark.createDataFrame([("m", 0, 1, True), ("m", 1, 1, False), ("m", 2, 1, True)],
                              "model string, doc_id long, attempt int, passed boolean")
    r = CMP.rescore_summary(s, o).collect()[0]
    assert (r.n, r.published, r.corrected, r.recovered, r.regressed) == (4, 50.0, 50.0, 1, 1)
    # identity: recovered - regressed = corrected - published (in items)
    assert r.recovered - r.regressed == round((r.corrected - r.published) * r.n / 100)


def test_duplicate_outcome_last_wins(spark):
    o = spark.createDataFrame([("m", 0, 1, False), ("m", 0, 2, True)],
                              "model string, doc_id long, attempt int, passed boolean")
    assert CMP.latest_outcomes(o, ["model", "doc_id"]).collect()[0].passed is True


def test_pass_at_k_estimator(spark):
    o = spark.createDataFrame([(1, p) for p in [True, True, False, False, False]], "item int, passed boolean")
    got = {r.k: round(r.pass_at_k, 4) for r in CMP.pass_at_k(o, "item", [1, 2]).collect()}
    assert got == {1: 0.4, 2: 0.7}


def test_pass_at_k_no_pass_is_zero(spark):
    o = spark.createDataFrame([(1, False), (1, False)], "item int, passed boolean")
    assert CMP.pass_at_k(o, "item", [1]).collect()[0].pass_at_k == 0.0


def _failures(spark, counts):
    rows, i = [], 0
    for v, n in counts.items():
        for _ in range(n):
            rows.append(("m", v, i))
            i += 1
    return spark.createDataFrame(rows, "model string, verdict string, doc_id long")


def test_sample_shares(spark):
    t = _failures(spark, {"WRONG_BLOCK": 129, "EMPTY_GENERATION": 10, "MODEL_SELF_TEST": 4, "GENUINE_FAILURE": 2})
    got = {r.verdict: r["count"] for r in TR.review_sample(t, 12, 7).groupBy("verdict").count().collect()}
    assert got == {"WRONG_BLOCK": 11, "EMPTY_GENERATION": 1, "MODEL_SELF_TEST": 1, "GENUINE_FAILURE": 1}


def test_sample_half_even(spark):
    t = _failures(spark, {"WRONG_BLOCK": 5, "GENUINE_FAILURE": 5})
    assert TR.review_sample(t, 5, 7).count() == 4


def test_sample_no_failures(spark):
    t = _failures(spark, {})
    assert TR.review_sample(t, 12, 7).count() == 0


def test_sample_partition_invariant(spark):
    t = _failures(spark, {"WRONG_BLOCK": 40, "GENUINE_FAILURE": 9})
    a = sorted(r.doc_id for r in TR.review_sample(t.repartition(1), 12, 7).collect())
    b = sorted(r.doc_id for r in TR.review_sample(t.repartition(8), 12, 7).collect())
    assert a == b


def test_empty_answer_predicate(spark):
    df = spark.createDataFrame([("m", [["  \n"]], None), ("m", None, ["x"]), ("m", [], [])],
                               "model string, resps array<array<string>>, filtered_resps array<string>")
    r = CMP.empty_answers(df, ["model"]).collect()[0]
    assert (r.n_empty, r.n_total) == (2, 3)


def test_run_diff(spark):
    a = spark.createDataFrame([("m", 1, "same", False)], "model string, doc_id int, t string, p boolean")
    b = spark.createDataFrame([("m", 1, "same", True)], "model string, doc_id int, t string, p boolean")
    r = CMP.run_diff(a, b, ["model", "doc_id"], "t", "p", ["model"]).collect()[0]
    assert (r.identical, r.flipped_up, r.flipped_down) == (1, 1, 0)
