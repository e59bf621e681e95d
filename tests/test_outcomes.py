"""Three-state outcomes, run comparison, model names (JN6, JN9, JN10, AG7-AG9, SNK8)."""

import itertools

import pytest
from pyspark.sql import functions as F

from runlens.operators import compare as CMP
from runlens.operators import model_keys as MK
from runlens.operators import outcomes as OC
from runlens.sinks import reports as SK

SAMPLES = "model string, doc_id long, pass_at_1 double"
OUTCOMES = "model string, doc_id long, attempt int, passed boolean"


def test_rates_speak_for_known_outcomes_only(spark):
    rows = [("m", 1, 1.0), ("m", 2, 0.0), ("m", 3, None), ("m", 4, None), ("m", 5, 1.0), ("n", 1, None), (None, 1, 1.0)]
    outs = [("m", 1, 1, False), ("m", 1, 2, True), ("m", 2, 1, True), ("m", 3, 1, True), (None, 1, 1, False)]
    got = {r.model: r for r in CMP.rescore_summary(spark.createDataFrame(rows, SAMPLES), spark.createDataFrame(outs, OUTCOMES)).collect()}
    m = got["m"]
    assert (m.n, m.n_known, m.coverage, m.n_rerun) == (5, 3, 0.6, 2)
    assert m.published == pytest.approx(200 / 3) and m.corrected == pytest.approx(200 / 3)  # item 3 passes now but was never scored
    assert (m.recovered, m.regressed) == (1, 1)
    assert (got["n"].n_known, got["n"].published, got["n"].corrected) == (0, None, None)
    assert (got[None].published, got[None].corrected, got[None].regressed) == (100.0, 0.0, 1)


def test_duplicate_items_count_once_as_corrected(spark):
    s = spark.createDataFrame([("m", 1, 0.0), ("m", 1, 0.0), ("m", 2, 0.0), ("m", 3, 1.0)], SAMPLES)
    o = spark.createDataFrame([("m", 1, 1, True), ("m", 3, 1, True)], OUTCOMES)
    r = CMP.rescore_summary(s, o).collect()[0]
    assert (r.corrected, r.recovered) == (50.0, 2)  # two distinct ids of four rows


def test_transitions_cover_all_pairs_and_add_up(spark):
    flags = [True, False, None]
    df = spark.createDataFrame([(a, b) for a, b in itertools.product(flags, flags) for _ in range(2)], "a boolean, b boolean")
    r = df.agg(*OC.transition_counts(F.col("a"), F.col("b"))).collect()[0].asDict()
    assert set(r.values()) == {2} and sum(r.values()) == 18


def test_score_states(spark):
    df = spark.createDataFrame([(1.0,), (0.0,), (0.5,), (None,), (float("nan"),)], "s double")
    assert [r[0] for r in df.select(OC.state(OC.from_score("s"))).collect()] == ["pass", "fail", "fail", "unknown", "unknown"]


def test_run_diff_counts_items_of_one_run(spark):
    schema = "model string, doc_id int, t string, p boolean"
    a = spark.createDataFrame([("m", 1, "x", False), ("m", 2, "y", True), ("m", 3, "z", None), (None, 4, "n", False)], schema)
    b = spark.createDataFrame([("m", 1, "x", True), ("m", 3, "q", True), ("m", 9, "w", True), (None, 4, "n", True)], schema)
    got = {r.model: r for r in CMP.run_diff(a, b, ["model", "doc_id"], "t", "p", ["model"]).collect()}
    m = got["m"]
    assert (m.n_items, m.only_a, m.only_b, m.identical, m.flipped_up, m.flipped_down, m.unknown) == (2, 1, 1, 1, 1, 0, 1)
    assert (got[None].n_items, got[None].identical, got[None].flipped_up) == (1, 1, 1)


def test_verdict_line_shows_missing_rates(spark):
    s = spark.createDataFrame([("m", 1, 1.0), ("m", 2, 0.0), ("n", 1, None)], SAMPLES)
    rates = CMP.rescore_summary(s, spark.createDataFrame([("m", 2, 1, True)], OUTCOMES))
    counts = spark.createDataFrame([("m", 1, 0, 0, 0)], "model string, WRONG_BLOCK long, MODEL_SELF_TEST long, EMPTY_GENERATION long, GENUINE_FAILURE long")
    got = {r.model: r.line.split() for r in SK.verdict_lines(rates, counts).collect()}
    assert got["m"][:5] == ["m", "50.0%", "50.0%", "1", "1"] and got["n"][1:3] == ["---", "---"]


def names(spark, xs):
    return spark.createDataFrame([(x, i) for i, x in enumerate(xs)], "name string, v int")


@pytest.mark.parametrize(
    ("left", "right", "meant"),
    [
        ("SRC1:q8_0", ["src12", "src1"], "src1"),  # family, not the longer name
        ("qwen3__8b", ["qwen3:8b", "qwen3"], "qwen3:8b"),  # file spelling of the same name
        ("org/Llama-3:q4", ["llama-3"], "llama-3"),
        ("llama-3.1-70b-instruct", ["llama-3.1", "llama-3.1-70b"], "llama-3.1-70b"),  # longest prefix
        ("qwen3-coder", ["qwen3-c"], None),  # part of a name part
        ("a:7b", ["a:13b"], None),  # two tags, two models
        ("gpt", ["gpt2"], None),
        (None, ["x"], None),
    ],
)
def test_model_names_meet(spark, left, right, meant):
    got = MK.reconcile(names(spark, [left]), "name", names(spark, right), "name").collect()
    assert [r.right for r in got] == ([meant] if meant else [])


def test_join_keeps_models_of_one_side(spark):
    a = spark.createDataFrame([("M1:q4", 10.0), ("M1:q8", 20.0), ("only-speed", 5.0), (None, 1.0)], "served string, tps double")
    b = spark.createDataFrame([("m1", 90.0), ("only-acc", 80.0), (None, 2.0)], "model string, acc double")
    got = {(r.served, r.model, r.model_key, r.tps, r.acc) for r in MK.join_on_model(a, "served", b, "model").collect()}
    assert got == {
        ("M1:q4", "m1", "m1", 10.0, 90.0), ("M1:q8", "m1", "m1", 20.0, 90.0), ("only-speed", None, "only-speed", 5.0, None),
        (None, "only-acc", "only-acc", None, 80.0), (None, None, None, 1.0, None), (None, None, None, None, 2.0),
    }


def test_every_labelled_share_matches_a_plain_count(spark):
    """The published rate of a source is the share of its labelled rows, whatever else it holds."""
    from runlens.plans import q_text as QT

    from .conftest import SF_SMALL

    docs = {r.doc_id: r.source for r in spark.read.parquet(f"{SF_SMALL}/documents.parquet").select("doc_id", "source").collect()}
    by = {}
    for r in spark.read.parquet(f"{SF_SMALL}/labels.parquet").collect():
        by.setdefault(docs[r.doc_id], []).append(r.quality)
    got = {r.model: r.published for r in QT.q_rescore(spark, SF_SMALL).collect()}
    assert {m: (p is not None) and p for m, p in got.items()} == {m: m in by and round(100 * sum(by[m]) / len(by[m]), 4) for m in got}
