"""Response records -> per-run metrics (projection, filter and ordering operators).

All operators keep one row per attempt; nothing is collected per group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions.text import word_count


def tokens_per_sec(eval_count, eval_duration_ns) -> Column:
    """[PF1] ``eval_count / (duration_ns / 1e9)`` when the duration is positive, else 0.0."""
    n, d = F.col(eval_count), F.col(eval_duration_ns)
    return F.when(d > 0, F.coalesce(n, F.lit(0)) / (d / F.lit(1e9))).otherwise(F.lit(0.0))


def elapsed_sec(total_duration_ns, signed: bool = True) -> Column:
    """[PF2, SC11] ``total_ns / 1e9`` when positive, else 0.0 (``signed=False``: the dialogue form,
    ``(x or 0) / 1e9`` without a sign test)."""
    t = F.col(total_duration_ns)
    if not signed:
        return F.coalesce(t, F.lit(0)) / F.lit(1e9)
    return F.when(t > 0, t / F.lit(1e9)).otherwise(F.lit(0.0))


def response_metrics(df: DataFrame, error_col: str | None = "error",
                     count_col: str = "eval_count", eval_col: str = "eval_duration",
                     total_col: str = "total_duration") -> DataFrame:
    """[PF1-PF3] Add ``tps`` and ``elapsed``; a failed attempt contributes 0.0 to both (it still
    counts as a run)."""
    tps = tokens_per_sec(count_col, eval_col)
    elap = elapsed_sec(total_col)
    if error_col is not None:
        failed = F.coalesce(F.col(error_col), F.lit(False))
        tps = F.when(failed, F.lit(0.0)).otherwise(tps)
        elap = F.when(failed, F.lit(0.0)).otherwise(elap)
    return df.withColumn("tps", tps).withColumn("elapsed", elap)


def metric_rows(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """[PV6] One measured response -> two metric rows (``metric``, ``value``), single pass."""
    return df.select(
        *keys,
        F.explode(F.array(
            F.struct(F.lit(schemas.TPS).alias("metric"), F.col("tps").alias("value")),
            F.struct(F.lit(schemas.ELAPSED).alias("metric"), F.col("elapsed").alias("value")),
        )).alias("m"),
    ).select(*keys, "m.metric", "m.value")


def drop_warmup(df: DataFrame, model_col: str, order_cols: Sequence[str],
                error_col: str = "error") -> DataFrame:
    """[PF4] Remove each model's first call (the warm-up); a model whose warm-up failed is
    removed altogether.

    The warm-up is found with a ``min`` over a struct of the ordering columns (map-side
    combined) and comes back on one null-safe join of one row a model; a null model is a
    model."""
    order = F.struct(*[F.col(c) for c in order_cols])
    failed = F.coalesce(F.col(error_col), F.lit(False))
    first = df.groupBy(model_col).agg(F.min(F.struct(order.alias("at"), failed.alias("failed"))).alias("_warm"))
    rows = null_safe_join(df, first, [model_col])
    return rows.filter(~F.col("_warm.failed") & ~order.eqNullSafe(F.col("_warm.at"))).drop("_warm")


def dialogue_metrics(df: DataFrame, count_col: str = "eval_count", eval_col: str = "eval_duration",
                     total_col: str = "total_duration") -> DataFrame:
    """[PF1, PF2] ``tps`` and ``elapsed`` of a measured dialogue turn.  Elapsed has the dialogue
    form: no sign test, a missing duration is 0 (failed turns never get here)."""
    return df.withColumn("tps", tokens_per_sec(count_col, eval_col)).withColumn("elapsed", elapsed_sec(total_col, signed=False))


def sample_turns(df: DataFrame, turn_col: str = "turn", base: str = "P9") -> DataFrame:
    """[PF5] Keep only dialogue turns 1, 3, 5 and name them ``P9_T<n>``."""
    return (
        df.filter(F.col(turn_col).isin(*schemas.SAMPLED_TURNS))
        .withColumn("prompt_id", F.concat(F.lit(base + "_T"), F.col(turn_col).cast("string")))
    )


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which a NULL key meets a NULL key, so no row is lost to it."""
    r = right.withColumnsRenamed({k: f"_r_{k}" for k in keys})
    on = [left[k].eqNullSafe(r[f"_r_{k}"]) for k in keys]
    return left.join(r, on, how).drop(*[f"_r_{k}" for k in keys])


def until_first_failure(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str],
                        failed: Column) -> DataFrame:
    """[WN4] Keep the rows strictly before the first failure of each group (the failed row
    and every later one are dropped).

    The first failure position is a grouped ``min`` (partial aggregation) joined
    back on the keys, so no window has to hold a whole group."""
    order = F.struct(*[F.col(c) for c in order_cols])
    marked = df.withColumn("_ord", order).withColumn("_failed", failed)
    stops = (
        marked.filter(F.col("_failed"))
        .groupBy(*keys).agg(F.min("_ord").alias("_stop"))
    )
    return (
        null_safe_join(marked, stops, keys, "left")
        .filter(F.col("_stop").isNull() | (F.col("_ord") < F.col("_stop")))
        .drop("_ord", "_failed", "_stop")
    )


def first_runs(df: DataFrame, keys: Sequence[str], order_cols: Sequence[str], k: int,
               name: str = "run_no") -> DataFrame:
    """[WN5, SR5] The first ``k`` runs of every group with their ordinal 1..k.

    ``row_number() <= k`` is planned with a partial ``WindowGroupLimit`` before the
    shuffle, so at most ``k`` rows per group and input partition are exchanged."""
    w = Window.partitionBy(*keys).orderBy(*[F.col(c) for c in order_cols])
    return df.withColumn(name, F.row_number().over(w)).filter(F.col(name) <= k)


def not_started_by(cells: DataFrame, started_col: str, cutoff: str) -> DataFrame:
    """[PF16] Deadline cut-off: flag cells whose first run started at or after ``cutoff``."""
    return cells.withColumn("skipped", F.col(started_col) >= F.lit(cutoff).cast(cells.schema[started_col].dataType))


def running_totals(df: DataFrame, key: str, order_col: str, values: dict[str, Column],
                   include_current: bool = False, bucket_width: int = 1024) -> DataFrame:
    """[WN3] Per ``key``, the sums of ``values`` (name -> column) over rows ordered by the
    numeric ``order_col`` strictly before the current row (or up to and including it).

    A distributed prefix sum, so one key holding a large share of all rows is never
    one task: rows fall into buckets of ``bucket_width`` consecutive order values;
    bucket totals (partial aggregation) get a prefix sum over the small bucket table;
    each row adds the running sum inside its own bucket (a window over at most
    ``bucket_width`` order values).  All sums share one pass; NULL keys are a group."""
    rows = df.withColumn("_b", F.floor(F.col(order_col) / F.lit(bucket_width)))
    rows = rows.withColumns({f"_v_{n}": c for n, c in values.items()})
    totals = rows.groupBy(key, "_b").agg(*[F.sum(f"_v_{n}").alias(f"_t_{n}") for n in values])
    before = Window.partitionBy(key).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(key, "_b", *[F.coalesce(F.sum(f"_t_{n}").over(before), F.lit(0)).alias(f"_o_{n}") for n in values])
    end = 0 if include_current else -1
    inside = Window.partitionBy(key, "_b").orderBy(order_col).rowsBetween(Window.unboundedPreceding, end)
    out = null_safe_join(rows, offsets, [key, "_b"])
    out = out.withColumns({n: F.col(f"_o_{n}") + F.coalesce(F.sum(f"_v_{n}").over(inside), F.lit(0)) for n in values})
    return out.drop("_b", *[f"_{x}_{n}" for n in values for x in "vo"])


def running_total(df: DataFrame, key: str, order_col: str, value: Column, name: str,
                  include_current: bool = False, bucket_width: int = 1024) -> DataFrame:
    """One running sum; see :func:`running_totals`."""
    return running_totals(df, key, order_col, {name: value}, include_current, bucket_width)


def dialogue_context(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn",
                     text_col: str = "text", bucket_width: int = 1024) -> DataFrame:
    """[WN3, SC6] Per turn: its word count and the words/messages of all earlier messages that a
    request at this turn carries (running sums, never a collected list; computed as
    a bucketed prefix sum so a very long conversation is split across tasks)."""
    t = turns.withColumn("words", word_count(text_col))
    sums = {"context_words": F.col("words").cast("bigint"), "context_messages": F.lit(1).cast("bigint")}
    return running_totals(t, conv_col, turn_col, sums, bucket_width=bucket_width)
