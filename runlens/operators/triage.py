"""Failure triage, review sampling and per-model summaries of generation samples."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import text as tx
from runlens.operators.extract import analyse_replies


def verdict(blank: str = "blank") -> Column:
    """[TX11] First match wins: blank reply -> EMPTY_GENERATION; original lacks and corrected
    has the entry point -> WRONG_BLOCK; original has it and self-tests ->
    MODEL_SELF_TEST; original lacks it -> EMPTY_GENERATION; else GENUINE_FAILURE."""
    od, cd, st = F.col("orig_defines"), F.col("corr_defines"), F.col("orig_self_test")
    return (F.when(F.col(blank), F.lit("EMPTY_GENERATION"))
            .when(~od & cd, F.lit("WRONG_BLOCK"))
            .when(od & st, F.lit("MODEL_SELF_TEST"))
            .when(~od, F.lit("EMPTY_GENERATION"))
            .otherwise(F.lit("GENUINE_FAILURE")))


def verdict_reason(blank: str = "blank") -> Column:
    """Which branch produced the verdict (EMPTY_GENERATION has two causes)."""
    od, cd, st = F.col("orig_defines"), F.col("corr_defines"), F.col("orig_self_test")
    return (F.when(F.col(blank), F.lit("blank reply"))
            .when(~od & cd, F.lit("solution in another block"))
            .when(od & st, F.lit("self-tests before hidden test"))
            .when(~od, F.lit("no entry point in extract"))
            .otherwise(F.lit("extract intact")))


def failures(samples: DataFrame, pass_col: str = "pass_at_1") -> DataFrame:
    """[PF10] Rows whose published score is exactly 0.0 (a missing score is not a failure)."""
    return samples.filter(F.col(pass_col) == 0.0)


def task_id_or_default(task_col: str = "task_id", doc_col: str = "doc_id") -> Column:
    return F.coalesce(F.col(task_col), F.concat(F.lit("doc_"), F.col(doc_col).cast("string")))


def triage(samples: DataFrame, raw: str = "raw", keep: Sequence[str] | None = None) -> DataFrame:
    """[PF14] Analyse replies (one Python pass) and attach verdict, reason and
    extraction_changed.  Blankness of the reply is decided natively, so the reply
    itself only needs to ride along when ``keep`` asks for it."""
    s = samples.withColumn("blank", tx.is_blank(raw))
    keep = [*(keep if keep is not None else samples.columns), "blank"]
    a = analyse_replies(s, raw=raw, keep=keep)
    return (a.withColumn("verdict", verdict("blank"))
            .withColumn("reason", verdict_reason("blank"))
            .withColumn("extraction_changed", tx.strip("original") != tx.strip("corrected")))


def verdict_counts(triaged: DataFrame, keys: Sequence[str], verdict_col: str = "verdict") -> DataFrame:
    """[AG6, PV7] Count per verdict, all four always present (0 when absent): a fixed-value
    pivot done as conditional aggregation in one pass."""
    return triaged.groupBy(*keys).agg(
        F.count(verdict_col).alias("n_failures"),
        *[F.count_if(F.col(verdict_col) == v).alias(v) for v in schemas.VERDICTS])


def review_sample(triaged: DataFrame, n: int, seed: int, model_col: str = "model",
                  verdict_col: str = "verdict", id_col: str = "doc_id") -> DataFrame:
    """[WN6] Seeded stratified sample of failures per model.

    Per verdict the share is ``max(1, round_half_even(n * n_v / max(N, 1)))``, at most
    ``n_v``.  Rows are ranked by ``md5(seed:id)`` (then id), which makes the choice
    independent of partitioning.  Shares never exceed ``max(n, 1)``, so a literal
    top-``max(n,1)`` limit runs first (a partial, map-side group limit) and the exact
    share is applied to those few survivors: a hot verdict is never sorted in one
    task."""
    kmax = max(n, 1)
    keys = [model_col, verdict_col]
    counts = triaged.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_v"))
    total = Window.partitionBy(model_col)
    share = F.least(F.col("n_v"), F.greatest(
        F.lit(1), F.bround(F.lit(n) * F.col("n_v") / F.greatest(F.sum("n_v").over(total), F.lit(1)), 0)
        .cast("bigint")))
    shares = counts.select(*keys, share.alias("share"))
    rank_key = F.md5(F.concat(F.lit(f"{seed}:"), F.col(id_col).cast("string")))
    w = Window.partitionBy(*keys).orderBy(rank_key, F.col(id_col))
    top = triaged.withColumn("_rk", F.row_number().over(w)).filter(F.col("_rk") <= kmax)
    return top.join(shares, keys).filter(F.col("_rk") <= F.col("share")).drop("_rk", "share")


def agreement(reviewed: DataFrame, agreed: str = "agreed", keys: Sequence[str] = ("model", "verdict")) -> DataFrame:
    """[AG16] Reviewer agreement: rows and share of agreed ones per key set, with subtotals
    (rollup).  A review without an answer counts as a row but not in the share."""
    return reviewed.rollup(*keys).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(agreed).cast("int")).alias("agree_rate"))
