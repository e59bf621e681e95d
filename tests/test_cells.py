"""Micro-goldens for run metrics and cell statistics (FIXTURES.md 3.1)."""

import math

import pytest
from pyspark.sql import functions as F

from runlens.operators import cells as C
from runlens.operators import runs as R


def _runs(spark, values, cell="c"):
    rows = [(cell, i + 1, float(v)) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "cell string, run_no int, value double")


def test_cell_stats_sample_variance(spark):
    r = C.cell_stats(_runs(spark, [10, 20, 30, 40, 50]), ["cell"]).collect()[0]
    assert (r.n, r.mean, r.variance, r.stdev) == (5, 30.0, 250.0, 15.8114)


def test_single_run_gives_zero_spread(spark):
    r = C.cell_stats(_runs(spark, [10]), ["cell"]).collect()[0]
    assert (r.n, r.mean, r.variance, r.stdev) == (1, 10.0, 0.0, 0.0)


def test_failed_attempt_counts_as_zero(spark):
    df = spark.createDataFrame(
        [(i, 10, 10 ** 9, 10 ** 9, i == 2) for i in range(1, 6)],
        "run_no int, eval_count long, eval_duration long, total_duration long, error boolean")
    m = R.response_metrics(df).withColumn("cell", F.lit("c"))
    r = C.cell_stats(m.withColumnRenamed("tps", "value"), ["cell"]).collect()[0]
    assert (r.n, r.mean, r.variance, r.stdev) == (5, 8.0, 20.0, 4.4721)


def test_dialogue_failure_drops_later_turns(spark):
    df = spark.createDataFrame([(1, 10.0, False), (2, 10.0, True), (3, 10.0, False), (4, 10.0, False),
                                (5, 10.0, False)], "turn int, value double, error boolean").withColumn("it", F.lit(1))
    kept = R.until_first_failure(df, ["it"], ["turn"], F.col("error"))
    assert [r.turn for r in kept.orderBy("turn").collect()] == [1]


def test_failure_break_per_iteration(spark):
    # iterations 1 and 2; iteration 2 fails at turn 3: T1 kept, T3 and T5 absent
    rows = [(it, t, 5.0, it == 2 and t == 3) for it in (1, 2) for t in range(1, 6)]
    df = spark.createDataFrame(rows, "it int, turn int, value double, error boolean")
    kept = R.sample_turns(R.until_first_failure(df, ["it"], ["turn"], F.col("error")))
    got = sorted((r.it, r.prompt_id) for r in kept.collect())
    assert got == [(1, "P9_T1"), (1, "P9_T3"), (1, "P9_T5"), (2, "P9_T1")]


def test_zero_or_missing_duration_gives_zero(spark):
    df = spark.createDataFrame([(5, 0, 0), (5, None, None)], "eval_count long, eval_duration long, total_duration long")
    got = R.response_metrics(df, error_col=None).select("tps", "elapsed").collect()
    assert [(r.tps, r.elapsed) for r in got] == [(0.0, 0.0), (0.0, 0.0)]


def test_padded_runs_pad_and_cut(spark):
    four = _runs(spark, [1, 2, 3, 4], "a").union(_runs(spark, [1, 2, 3, 4, 5, 6], "b"))
    p = {r.cell: list(r.runs) for r in C.padded_runs(four, ["cell"], ["run_no"]).collect()}
    assert p == {"a": [1.0, 2.0, 3.0, 4.0, 0.0], "b": [1.0, 2.0, 3.0, 4.0, 5.0]}
    audit = {r.cell: r.mismatch for r in
             C.stat_audit(C.padded_runs(four, ["cell"], ["run_no"]), C.cell_stats(four, ["cell"]), ["cell"]).collect()}
    assert audit == {"a": True, "b": True}


def test_first_runs_is_planned_with_a_partial_group_limit(spark):
    df = _runs(spark, list(range(100)))
    plan = R.first_runs(df, ["cell"], ["run_no"], 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_warmup_removal(spark):
    df = spark.createDataFrame([("a", 1, False), ("a", 2, False), ("b", 1, True), ("b", 2, False)],
                               "model string, ord int, error boolean")
    got = sorted((r.model, r.ord) for r in R.drop_warmup(df, "model", ["ord"]).collect())
    assert got == [("a", 2)]


def test_first_last_value_per_group(spark):
    df = spark.createDataFrame([("m", 1, "1 GB"), ("m", 2, "2 GB")], "model string, ord int, size string")
    assert C.first_value(df, ["model"], "size", ["ord"]).collect()[0].size == "1 GB"
    assert C.last_value(df, ["model"], "size", ["ord"]).collect()[0].size == "2 GB"


def test_coverage_gaps(spark):
    obs = spark.createDataFrame([("m", "P1", 1), ("m", "P1", 2)], "model string, prompt_id string, run_no int")
    gaps = C.coverage_gaps(obs, obs, "model", ["P1", "P2"], 2)
    assert sorted((r.prompt_id, r.run_no) for r in gaps.collect()) == [("P2", 1), ("P2", 2)]


def test_robust_limits_interpolate(spark):
    df = spark.createDataFrame([(float(v),) for v in range(101)], "v double").withColumn("k", F.lit(1))
    r = C.robust_limits(df, ["k"], "v").collect()[0]
    assert math.isclose(r.vmin, 2.0) and math.isclose(r.vmax, 98.0)


@pytest.mark.parametrize("secs,text", [(0, "00:00:00"), (3661, "01:01:01"), (360000, "100:00:00")])
def test_hhmmss_unbounded_hours(spark, secs, text):
    from runlens.functions.text import hhmmss

    assert spark.range(1).select(hhmmss(F.lit(secs))).collect()[0][0] == text


def test_running_total_across_buckets(spark):
    import random

    rnd = random.Random(3)
    rows = [(c, t, rnd.randint(0, 9)) for c in (1, 2) for t in range(0, 50)]
    df = spark.createDataFrame(rows, "conv long, turn long, v long")
    got = R.running_total(df, "conv", "turn", F.col("v"), "before", bucket_width=3)
    got = R.running_total(got, "conv", "turn", F.col("v"), "upto", include_current=True, bucket_width=3)
    res = {(r.conv, r.turn): (r.before, r.upto) for r in got.collect()}
    for c in (1, 2):
        acc = 0
        for t in range(50):
            v = [x for (cc, tt, x) in rows if cc == c and tt == t][0]
            assert res[(c, t)] == (acc, acc + v)
            acc += v


def test_exact_percentiles_distributed_match_builtin(spark):
    import random

    rnd = random.Random(11)
    # one hot group holding most rows, plus small groups; ties included
    rows = [("hot", float(rnd.randint(0, 500))) for _ in range(5000)]
    rows += [(f"g{i}", rnd.random() * 100) for i in range(20) for _ in range(rnd.randint(1, 30))]
    df = spark.createDataFrame(rows, "k string, v double").repartition(7)
    got = {(r.k, r.p): r.value for r in C.exact_percentiles(df, ["k"], "v", [0.02, 0.5, 0.98], partitions=9).collect()}
    want = df.groupBy("k").agg(F.percentile("v", F.array(F.lit(0.02), F.lit(0.5), F.lit(0.98))).alias("q")).collect()
    for r in want:
        for i, p in enumerate([0.02, 0.5, 0.98]):
            assert math.isclose(got[(r.k, p)], r.q[i], rel_tol=1e-12, abs_tol=1e-9), (r.k, p)
    lim = {r.k: (r.vmin, r.vmax) for r in C.robust_limits(df, ["k"], "v", bounded=False).collect()}
    assert math.isclose(lim["hot"][0], [x.q[0] for x in want if x.k == "hot"][0])


def test_cluster_conf_sizes_partitions():
    from runlens.session import cluster_conf

    c = cluster_conf(shuffle_bytes=100 << 40, cores=8000)
    assert int(c["spark.sql.shuffle.partitions"]) == (100 << 40) // (128 << 20)
    assert c["spark.sql.adaptive.skewJoin.enabled"] == "true" and "spark.checkpoint.dir" not in c


def test_ranked_matches_row_number_with_hot_group(spark):
    from pyspark.sql import Window

    rows = [("hot" if i % 5 else f"g{i % 3}", i * 7 % 1009, i) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, t long, id long").repartition(5)
    got = {r.id: r.rank for r in C.ranked(df, ["k"], ["t", "id"], partitions=11).collect()}
    want = df.withColumn("rn", F.row_number().over(Window.partitionBy("k").orderBy("t", "id")) - 1)
    assert got == {r.id: r.rn for r in want.collect()}


def test_means_keep_small_and_large_values(spark):
    rows = [("tiny", 4e-10)] * 2 + [("third", 1 / 3e6)] + [("huge", 9e28)] * 20
    got = {r.k: r.mean for r in C.cell_stats(spark.createDataFrame(rows, "k string, value double"), ["k"], places=None).collect()}
    assert got["tiny"] == pytest.approx(4e-10) and got["third"] == pytest.approx(1 / 3e6) and got["huge"] == pytest.approx(9e28)


def test_null_keys_are_groups(spark):
    from runlens.operators import runs as R

    df = spark.createDataFrame([(None, 1, 5), (None, 2, 7), ("a", 1, 1), ("a", 2, 2)], "k string, t long, v long")
    assert C.ranked(df, ["k"], ["t"]).count() == 4
    got = {(r.k, r.t): r.s for r in R.running_total(df, "k", "t", F.col("v"), "s").collect()}
    assert got == {(None, 1): 0, (None, 2): 5, ("a", 1): 0, ("a", 2): 1}
    assert R.until_first_failure(df, ["k"], ["t"], F.col("v") == 7).count() == 3


def test_nan_takes_no_part_in_limits(spark):
    df = spark.createDataFrame([("k", 1.0), ("k", 2.0), ("k", float("nan"))], "k string, v double")
    for bounded in (True, False):
        r = C.robust_limits(df, ["k"], "v", bounded=bounded).collect()[0]
        assert (r.vmin, r.vmax) == (pytest.approx(1.02), pytest.approx(1.98))


def test_token_cells_list_every_run(spark):
    df = spark.createDataFrame([("m", i, 10 + i, 3, 0, 1.0) for i in range(8)], "model string, at long, gen_tokens long, prompt_tokens long, thinking_chars long, wall_s double")
    r = C.token_cells(df, ["model"], ["at"], F.lit(False)).collect()[0]
    assert r.gen_tokens_runs == [10 + i for i in range(8)] and r.n_runs == 8
