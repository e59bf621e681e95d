"""Micro-goldens for matrix / pivot operators and scalar formatting (FIXTURES.md 3.2)."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import cells as C
from runlens.operators import matrix as M


def test_grand_mean_and_sd(spark):
    df = spark.createDataFrame([("m", "P1", 10.0), ("m", "P2", 20.0), ("m", "P3", 30.0), ("n", "P1", 10.0)],
                               "model string, prompt_id string, mean double")
    got = {r.model: (r.grand_mean, r.cross_prompt_sd) for r in C.grand_mean(df, ["model"]).collect()}
    assert got == {"m": (20.0, 10.0), "n": (10.0, None)}


def test_grand_mean_skips_nan(spark):
    df = spark.createDataFrame([("m", 10.0), ("m", float("nan")), ("m", 30.0)], "model string, mean double")
    assert C.grand_mean(df, ["model"]).collect()[0].grand_mean == 20.0


def test_two_sizes_are_two_groups(spark):
    df = spark.createDataFrame([("m", "1 GB", 10.0), ("m", "2 GB", 20.0)], "model string, size string, mean double")
    assert C.grand_mean(df, ["model", "size"]).count() == 2


def test_coefficient_of_variation(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.0, 1.0), (2.0, 1.0)], "mean double, sd double")
    got = [r[0] for r in df.select(M.coefficient_of_variation("sd", "mean")).collect()]
    assert math.isnan(got[0]) and got[1] == float("inf") and got[2] == 0.5


def test_strict_pivot_rejects_duplicates(spark):
    df = spark.createDataFrame([("m", "P1", 1.0), ("m", "P1", 2.0)], "model string, prompt_id string, mean double")
    with pytest.raises(Exception):
        M.pivot_cells(df, "model", "prompt_id", "mean", ["P1"], on_duplicate="error").collect()


def test_lenient_pivot_last_wins(spark):
    df = spark.createDataFrame([("m", "P1", 1.0, 1), ("m", "P1", 2.0, 2)],
                               "model string, prompt_id string, mean double, ord int")
    r = M.pivot_cells(df, "model", "prompt_id", "mean", ["P1", "P2"], on_duplicate="last", order_col="ord").collect()[0]
    assert (r.P1, r.P2) == (2.0, None)


def test_natural_prompt_order(spark):
    df = spark.createDataFrame([(p,) for p in ["P10", "P9_T5", "P2", "P9_T1"]], "prompt_id string")
    assert M.ordered_prompts(df) == ["P2", "P9_T1", "P9_T5", "P10"]


def test_prompt_id_predicate(spark):
    ids = ["P1", "P9_T3", "PX", "P1_T", "p1"]
    df = spark.createDataFrame([(p,) for p in ids], "prompt_id string")
    assert [r[0] for r in df.select(M.is_prompt_id("prompt_id")).collect()] == [True, True, False, False, False]


def test_prompt_selection_keeps_request_order(spark):
    present = spark.createDataFrame([(p,) for p in ["P1", "P2", "P11"]], "prompt_id string")
    chosen, skipped = M.select_prompts(present, ["P2", "P77", "P1"])
    assert [r.prompt_id for r in chosen.orderBy("req_ord").collect()] == ["P2", "P1"]
    assert [r.prompt_id for r in skipped.collect()] == ["P77"]


def test_metric_bucketing(spark):
    df = spark.createDataFrame([("m", "P1", "Tokens_Per_Sec", 1.0, 0.1), ("m", "P1", "Foo", 2.0, 0.2)],
                               "model string, prompt_id string, metric string, mean double, stdev double")
    r = C.metric_pair(df, ["model", "prompt_id"]).collect()[0]
    assert (r.tps_mean, r.elap_mean) == (1.0, 2.0)


def test_castable_filter(spark):
    df = spark.createDataFrame([("abc",), ("nan",), ("1.5",)], "t string")
    got = [r[0] for r in df.select(F.col("t").try_cast("double").alias("v")).filter("v is not null").collect()]
    assert len(got) == 2 and math.isnan(got[0]) and got[1] == 1.5


@pytest.mark.parametrize("x,text", [(1.25, "1.2"), (0.05, "0.1"), (0.35, "0.3"), (1234.25, "1234.2")])
def test_one_decimal_like_python(spark, x, text):
    assert spark.range(1).select(tx.fmt1(F.lit(x))).collect()[0][0] == text == "%.1f" % x


def test_escape_and_keys(spark):
    r = spark.range(1).select(tx.tex_escape(F.lit("a_b&c%")).alias("e"), tx.safe_key(F.lit("m:7b.q")).alias("k"),
                              tx.word_count(F.lit("  two  words\n")).alias("w"), tx.word_count(F.lit("  ")).alias("z")
                              ).collect()[0]
    assert (r.e, r.k, r.w, r.z) == ("a\\_b\\&c\\%", "m_7b_q", 2, 0)


def test_split_first_colon(spark):
    base, suffix = tx.split_first(F.lit("a:b:c"))
    r = spark.range(1).select(base.alias("b"), suffix.alias("s")).collect()[0]
    assert (r.b, r.s) == ("a", "b:c")


def test_quote_lines(spark):
    got = spark.range(1).select(tx.quote_lines(F.lit("  a\n\nb  "))).collect()[0][0]
    assert got == "> a\n>\n> b"


def test_pivot_unpivot_identity(spark):
    cells = spark.createDataFrame([(m, p, float(i)) for i, (m, p) in enumerate(
        [(m, p) for m in ("a", "b", "c") for p in ("P1", "P2", "P9_T1", "P10")])],
        "model string, prompt_id string, mean double")
    cols = ["P1", "P2", "P9_T1", "P10"]
    wide = M.pivot_cells(cells, "model", "prompt_id", "mean", cols)
    back = wide.unpivot("model", cols, "prompt_id", "mean").filter(F.col("mean").isNotNull())
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, cells.collect()))


def test_cell_stats_partition_invariant(spark):
    import random

    rnd = random.Random(5)
    rows = [("hot" if i % 10 else f"c{i % 7}", rnd.random() * 1000) for i in range(20000)]
    df = spark.createDataFrame(rows, "cell string, value double")
    one = sorted(map(tuple, C.cell_stats(df.repartition(1), ["cell"]).collect()))
    many = sorted(map(tuple, C.cell_stats(df.repartition(9), ["cell"]).collect()))
    assert one == many
