"""Cell statistics and the grouped operators over cells.

A *cell* is one (model, prompt, metric) group of runs.  Every statistic here is a
built-in aggregate with partial (map-side) aggregation, so a cell holding a large
share of all runs is combined before the shuffle rather than in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.operators.runs import first_runs, null_safe_join


def cell_stats(runs: DataFrame, keys: Sequence[str], value: str = "value",
               places: int | None = 4, extra: Sequence[Column] = ()) -> DataFrame:
    """[AG1] Mean, *sample* variance and *sample* stdev per cell; one run -> 0 for both.
    NaN propagates.  Shown values are rounded to 9 places first, so that a mean that lies
    on a rounding edge does not depend on the order in which partial sums are combined.
    ``extra``: further named aggregates of the same pass."""
    v = F.col(value)
    out = runs.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg(v).alias("mean"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"),
        *extra,
    )
    if places is not None:
        out = out.withColumns({c: F.round(F.round(c, 9), places) for c in ("mean", "variance", "stdev")})
    return out


def planned_stats(runs: DataFrame, plan: DataFrame, keys: Sequence[str], value: str = "value",
                  places: int | None = 4) -> DataFrame:
    """[AG1] Cell statistics over a planned grid: a planned cell without a run has n = 0 and
    zeros, as the dialogue cells of a model that never got to a turn.  ``plan``: one row a
    planned cell (the keys); a cell that was run but not planned stays."""
    stats = cell_stats(runs, keys, value, places)
    marked = plan.select(*keys).distinct()
    left = null_safe_join(marked, stats, keys, "left")
    unplanned = null_safe_join(stats, marked, keys, "left_anti")
    zeros = {"n": 0, "mean": 0.0, "variance": 0.0, "stdev": 0.0}
    filled = left.select(*keys, *[F.coalesce(F.col(c), F.lit(z)).alias(c) for c, z in zeros.items()])
    return filled.unionByName(unplanned.select(*keys, *zeros))


def padded_runs(runs: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                value: str = "value", width: int = schemas.RUNS_EXPORTED) -> DataFrame:
    """[AG2] The exported run array: runs in order, padded with 0.0 and cut to ``width``.

    Only the first ``width`` runs per cell are ever shuffled (``first_runs``); the
    array is assembled from at most ``width`` elements."""
    first = first_runs(runs, keys, order_cols, width)
    arr = F.transform(
        F.array_sort(F.collect_list(F.struct("run_no", value))), lambda s: s[value]
    )
    padded = F.slice(F.concat(arr, F.array_repeat(F.lit(0.0), width)), 1, width)
    return first.groupBy(*keys).agg(padded.alias("runs"))


def grand_mean(cells: DataFrame, keys: Sequence[str], mean_col: str = "mean") -> DataFrame:
    """[AG3] Mean and sample SD of the per-prompt means; NaN is skipped (NULLed first)."""
    m = F.when(F.isnan(F.col(mean_col)), F.lit(None)).otherwise(F.col(mean_col))
    return cells.groupBy(*keys).agg(
        F.count(m).alias("n_prompts"),
        F.avg(m).alias("grand_mean"),
        F.stddev_samp(m).alias("cross_prompt_sd"),
    )


def first_value(df: DataFrame, keys: Sequence[str], value: str, order_cols: Sequence[str],
                name: str | None = None) -> DataFrame:
    """[AG4] Value of the first row per group in row order (``min_by`` over the order, the
    value itself breaking ties so the result is deterministic)."""
    order = F.struct(*[F.col(c) for c in order_cols], F.col(value))
    return df.groupBy(*keys).agg(F.min_by(F.col(value), order).alias(name or value))


def last_value(df: DataFrame, keys: Sequence[str], value: str, order_cols: Sequence[str],
               name: str | None = None) -> DataFrame:
    """[AG5] Value of the last row per group (later rows win)."""
    order = F.struct(*[F.col(c) for c in order_cols], F.col(value))
    return df.groupBy(*keys).agg(F.max_by(F.col(value), order).alias(name or value))


def last_wins(df: DataFrame, keys: Sequence[str], values: Sequence[str], order_col: str) -> DataFrame:
    """[WN2, AG15] Dedupe: keep the values of the last row per key (aggregate, not a window)."""
    packed = F.max_by(F.struct(*[F.col(v) for v in values]), F.col(order_col)).alias("_v")
    return df.groupBy(*keys).agg(packed).select(*keys, *[F.col(f"_v.{v}").alias(v) for v in values])


def metric_pair(cells: DataFrame, keys: Sequence[str], metric_col: str = "metric",
                mean_col: str = "mean", sd_col: str = "stdev") -> DataFrame:
    """[JN4, PF9] tps and elapsed of one (model, prompt) on one row; any metric other than
    tokens/s is bucketed as elapsed.  Conditional aggregation, no self-join."""
    bucket = F.when(F.col(metric_col) == schemas.TPS, F.lit("tps")).otherwise(F.lit("elap"))
    c = cells.withColumn("_b", bucket)

    def pick(b: str, v: str) -> Column:
        return F.max(F.when(F.col("_b") == b, F.col(v)))

    return c.groupBy(*keys).agg(
        pick("tps", mean_col).alias("tps_mean"), pick("tps", sd_col).alias("tps_sd"),
        pick("elap", mean_col).alias("elap_mean"), pick("elap", sd_col).alias("elap_sd"),
    )


def first_seen(df: DataFrame, key: str, order_col: str, distinct_of: Sequence[str] = ()) -> DataFrame:
    """[WN1, AG14] First-appearance order of keys plus a distinct profile (rows, first position,
    distinct count of each ``distinct_of`` column), in one aggregation.

    The rank is taken over the aggregated keys only (one row per key)."""
    agg = df.groupBy(key).agg(F.min(order_col).alias("first_ord"), F.count(F.lit(1)).alias("n_rows"),
                              *[F.count_distinct(c).alias(f"n_{c}s") for c in distinct_of])
    return agg.withColumn("seen_rank", F.row_number().over(Window.orderBy("first_ord", key)))


def robust_limits(df: DataFrame, keys: Sequence[str], value: str,
                  lo: float = 0.02, hi: float = 0.98, bounded: bool = True) -> DataFrame:
    """[AG17] Exact 2nd / 98th percentiles (linear interpolation) of the shown cell values.

    NaN and NULL values take no part.  ``bounded``: the input is a cell matrix (one value
    per model x prompt), so the built-in ``percentile`` aggregate, whose buffer counts a
    group's distinct values, is fine.  Otherwise :func:`exact_percentiles` computes the
    same values without holding any group in one task."""
    if not bounded:
        e = exact_percentiles(df, keys, value, [lo, hi])
        return e.groupBy(*keys).agg(F.max(F.when(F.col("p") == lo, F.col("value"))).alias("vmin"),
                                    F.max(F.when(F.col("p") == hi, F.col("value"))).alias("vmax"))
    p = F.percentile(F.when(~F.isnan(F.col(value).cast("double")), F.col(value)), F.array(F.lit(lo), F.lit(hi)))
    return df.groupBy(*keys).agg(p.alias("_p")).select(
        *keys, F.col("_p")[0].alias("vmin"), F.col("_p")[1].alias("vmax"))


def ranked(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], name: str = "rank",
           partitions: int | None = None) -> DataFrame:
    """[WN5] 0-based position of every row inside its group in ``order_cols`` order
    (``row_number() - 1``), for groups of any size.

    Range-partitioning by (keys, order) spreads a large group, in order, over many
    partitions; the tagged rows are checkpointed once so partition ids and
    ``monotonically_increasing_id`` stay fixed; a row's position is the count of its
    group in earlier partitions (prefix sum over the small per-partition count
    table) plus its offset from the group's first row in its own partition."""
    from runlens.session import materialize

    spark = df.sparkSession
    # as many range partitions as the (data-sized) shuffle partition count, at least
    # one per core, so each holds a bounded slice of even the largest group
    n_parts = partitions or max(2, spark.sparkContext.defaultParallelism,
                                int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = df.repartitionByRange(n_parts, *keys, *order_cols).sortWithinPartitions(*keys, *order_cols)
    tagged = materialize(ordered.withColumn("_pid", F.spark_partition_id())
                         .withColumn("_mid", F.monotonically_increasing_id()))
    per = tagged.groupBy(*keys, "_pid").agg(F.count(F.lit(1)).alias("_c"), F.min("_mid").alias("_first"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_pid", "_first", F.coalesce(F.sum("_c").over(earlier), F.lit(0)).alias("_off"))
    return (null_safe_join(tagged, per, [*keys, "_pid"])
            .withColumn(name, F.col("_off") + F.col("_mid") - F.col("_first"))
            .drop("_pid", "_mid", "_first", "_off"))


def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, ps: Sequence[float],
                      partitions: int | None = None) -> DataFrame:
    """[AG17] Exact percentiles with linear interpolation (the ``percentile`` definition:
    position p*(n-1) between the two neighbouring ranks) for groups of any size.

    Equal values are counted first, with map-side combine, so a value that holds much
    of a group is one row; the distinct values are spread in order by range partitions,
    and running counts give each the ranks it covers."""
    from runlens.session import materialize

    spark = df.sparkSession
    n_parts = partitions or max(2, spark.sparkContext.defaultParallelism,
                                int(spark.conf.get("spark.sql.shuffle.partitions")))
    v = df.select(*keys, F.col(value).alias("_v")).filter(F.col("_v").isNotNull() & ~F.isnan("_v"))
    counts = v.groupBy(*keys, "_v").agg(F.count(F.lit(1)).alias("_c"))
    tagged = materialize(counts.repartitionByRange(n_parts, *keys, "_v").withColumn("_pid", F.spark_partition_id()))
    per = tagged.groupBy(*keys, "_pid").agg(F.sum("_c").alias("_pc"))
    earlier = Window.partitionBy(*keys).orderBy("_pid").rowsBetween(Window.unboundedPreceding, -1)
    per = per.select(*keys, "_pid", F.coalesce(F.sum("_pc").over(earlier), F.lit(0)).alias("_off"))
    inside = Window.partitionBy(*keys, "_pid").orderBy("_v").rowsBetween(Window.unboundedPreceding, 0)
    upto = null_safe_join(tagged, per, [*keys, "_pid"]).withColumn("_to", F.col("_off") + F.sum("_c").over(inside))
    covers = upto.select(*keys, "_v", (F.col("_to") - F.col("_c")).alias("_from"), "_to")
    totals = tagged.groupBy(*keys).agg(F.sum("_c").alias("_n"))
    pos = F.col("_p") * (F.col("_n") - 1)
    targets = (totals.select(*keys, "_n", F.explode(F.array(*[F.lit(float(p)) for p in ps])).alias("_p"))
               .select(*keys, "_p", pos.alias("_pos"), F.floor(pos).alias("_lo"), F.ceil(pos).alias("_hi")))
    hit = null_safe_join(covers, targets, keys).filter((F.col("_from") <= F.col("_hi")) & (F.col("_lo") < F.col("_to")))
    lo = F.max(F.when(F.col("_from") <= F.col("_lo"), F.when(F.col("_lo") < F.col("_to"), F.col("_v"))))
    hi = F.max(F.when(F.col("_from") <= F.col("_hi"), F.when(F.col("_hi") < F.col("_to"), F.col("_v"))))
    res = hit.groupBy(*keys, "_p", "_pos", "_lo").agg(lo.alias("_vlo"), hi.alias("_vhi"))
    interp = F.col("_vlo") + (F.col("_pos") - F.col("_lo")) * (F.col("_vhi") - F.col("_vlo"))
    return res.select(*keys, F.col("_p").alias("p"), interp.alias("value"))


def recomputed(runs_col: str = "runs") -> dict[str, Column]:
    """Mean, sample variance and sample stdev of the exported runs (one run: 0 for both)."""
    arr = F.col(runs_col)
    mean = F.aggregate(arr, F.lit(0.0), lambda acc, x: acc + x) / F.size(arr)
    spread = F.aggregate(F.transform(arr, lambda x: F.pow(x - mean, 2)), F.lit(0.0), lambda acc, x: acc + x)
    variance = F.when(F.size(arr) > 1, spread / (F.size(arr) - 1)).otherwise(F.lit(0.0))
    return {"mean": mean, "variance": variance, "stdev": F.sqrt(variance)}


def stat_audit(padded: DataFrame, stats: DataFrame, keys: Sequence[str], tol: float = 5e-5) -> DataFrame:
    """[AG18] Recompute mean, variance and stdev from the exported runs and flag cells where one
    disagrees with the stored value (catches 0.0 padding, cut runs and wrong spreads)."""
    again = recomputed("runs")
    j = null_safe_join(stats, padded, keys).withColumns({f"_{k}": v for k, v in again.items()})
    shown = [c for k in again for c in (F.col(k).alias(f"stored_{k}"), F.round(f"_{k}", 4).alias(f"recomputed_{k}"))]
    wrong = {k: F.abs(F.col(f"_{k}") - F.col(k)) > tol for k in again}
    flags = [F.coalesce(c, F.lit(False)).alias(f"{k}_mismatch") for k, c in wrong.items()]
    return j.select(*keys, "n", *shown, *flags, F.coalesce(wrong["mean"] | wrong["variance"] | wrong["stdev"], F.lit(False)).alias("mismatch"))


def coverage_gaps(observed: DataFrame, models: DataFrame, model_col: str, prompts: Sequence[str],
                  reps: int, prompt_col: str = "prompt_id", run_col: str = "run_no") -> DataFrame:
    """[JN8] Planned (model x prompt x repetition) points that were not observed.

    The plan is generated per model by exploding a literal array (no join of
    dimensions), then anti-joined against the observations."""
    grid = F.array(*[
        F.struct(F.lit(p).alias(prompt_col), F.lit(r).alias(run_col))
        for p in prompts for r in range(1, reps + 1)
    ])
    plan = models.select(model_col).distinct().select(model_col, F.explode(grid).alias("_g")) \
        .select(model_col, f"_g.{prompt_col}", f"_g.{run_col}")
    obs = observed.select(model_col, prompt_col, F.col(run_col).cast("int").alias(run_col))
    return plan.join(obs, [model_col, prompt_col, run_col], "left_anti")


def workload_seconds(df: DataFrame, ts_col: str, keys: Sequence[str] = ()) -> DataFrame:
    """[AG19] Elapsed workload time ``max(ts) - min(ts)`` in whole seconds."""
    g = df.groupBy(*keys) if keys else df.groupBy()
    agg = g.agg(F.min(ts_col).alias("_s"), F.max(ts_col).alias("_e"))
    secs = F.floor(F.timestamp_diff("MICROSECOND", F.col("_s"), F.col("_e")) / F.lit(1000000)).cast("bigint")
    return agg.select(*keys, secs.alias("seconds"))


def token_cells(runs: DataFrame, keys: Sequence[str], order_cols: Sequence[str], failed: Column) -> DataFrame:
    """[AG13] Token-count cell: mean generated tokens, every run's token count in order,
    the first run's prompt tokens, mean thinking chars and mean wall seconds, in one
    aggregate.  The cell stops at its first failed run (that run and later ones excluded).
    The list is the result itself: it holds a cell's runs, one number each."""
    from runlens.operators.runs import until_first_failure

    ok = until_first_failure(runs, keys, order_cols, failed)
    order = F.struct(*[F.col(c) for c in order_cols])
    listed = F.array_sort(F.collect_list(F.struct(*order_cols, F.col("gen_tokens").alias("_g"))))
    return ok.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_runs"),
        F.avg("gen_tokens").alias("gen_tokens_mean"),
        F.min_by("prompt_tokens", order).alias("prompt_tokens"),
        F.avg("thinking_chars").alias("thinking_chars_mean"),
        F.avg("wall_s").alias("wall_s_mean"),
        F.transform(listed, lambda s: s["_g"]).alias("gen_tokens_runs"),
    )


#: Runs of a cell that one row of a chunked list holds.
CHUNK = 1000


def token_chunks(runs: DataFrame, keys: Sequence[str], order_cols: Sequence[str], failed: Column,
                 value: str = "gen_tokens", size: int = CHUNK) -> DataFrame:
    """[AG13] The ordered token counts of every cell as rows (keys, chunk, n, ``value``_runs) of at
    most ``size`` runs each; chunks 0, 1, ... put together are the cell's list, up to its first
    failed run.  Places come from :func:`ranked`, so no buffer grows with a cell."""
    from runlens.operators.runs import until_first_failure

    ok = until_first_failure(runs, keys, order_cols, failed)
    placed = ranked(ok.select(*keys, *[c for c in order_cols if c not in keys], value), keys, order_cols, "_place")
    placed = placed.withColumn("chunk", F.floor(F.col("_place") / F.lit(size)))
    listed = F.array_sort(F.collect_list(F.struct("_place", value)))
    return placed.groupBy(*keys, "chunk").agg(F.count(F.lit(1)).alias("n"), F.transform(listed, lambda s: s[value]).alias(f"{value}_runs"))


def castable(df: DataFrame, text: str, name: str = "value") -> DataFrame:
    """[PF8] Rows whose ``text`` is a number, with the number as ``name`` (NaN as null) and
    ``is_nan``; rows with other text go."""
    v = F.col(text).try_cast("double")
    rows = df.withColumn("_v", v).filter(F.col("_v").isNotNull())
    return rows.withColumn(name, F.when(~F.isnan("_v"), F.col("_v"))).withColumn("is_nan", F.isnan("_v")).drop("_v")
