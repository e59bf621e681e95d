"""Pivot / matrix operators over cells (model x prompt), natural prompt order,
coefficient of variation, relabelling and prompt selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas


def prompt_number(pid) -> Column:
    c = F.col(pid) if isinstance(pid, str) else pid
    return F.regexp_extract(c, r"^P([0-9]+)", 1).try_cast("int")


def prompt_turn(pid) -> Column:
    c = F.col(pid) if isinstance(pid, str) else pid
    return F.coalesce(F.regexp_extract(c, r"_T([0-9]+)$", 1).try_cast("int"), F.lit(0))


def natural_order(pid="prompt_id") -> list[Column]:
    """[SR1, PV3] Sort keys for the natural prompt order: (number, turn or 0)."""
    return [prompt_number(pid), prompt_turn(pid)]


def is_prompt_id(pid="prompt_id") -> Column:
    c = F.col(pid) if isinstance(pid, str) else pid
    return c.rlike(schemas.PROMPT_ID_PATTERN)


def ordered_prompts(cells: DataFrame, pid: str = "prompt_id") -> list[str]:
    """[PV3] Distinct prompt ids in natural order.  Collects only the distinct ids (a tiny,
    bounded list); used to fix pivot columns when no explicit list is given."""
    rows = (cells.select(pid).distinct().filter(is_prompt_id(pid))
            .orderBy(*natural_order(pid), pid).collect())
    return [r[0] for r in rows]


def pivot_cells(cells: DataFrame, row: str, col: str, value: str, columns: Sequence[str],
                on_duplicate: str = "error", order_col: str | None = None) -> DataFrame:
    """[PV1, PV2] Row x column matrix of ``value``.

    ``on_duplicate='error'``: a repeated (row, col) pair fails the job (strict pivot).
    ``on_duplicate='last'``: the last row by ``order_col`` wins (lenient pivot).
    Columns are given explicitly so no extra pass is needed to discover them."""
    if on_duplicate == "error":
        g = cells.groupBy(row, col).agg(F.count(F.lit(1)).alias("_n"), F.first(value).alias("_v"))
        guarded = F.when(F.assert_true(F.col("_n") == 1, F.lit("duplicate cell in strict pivot")).isNull(),
                         F.col("_v"))
        g = g.select(row, col, guarded.alias(value))
    elif on_duplicate == "last":
        if order_col is None:
            raise ValueError("on_duplicate='last' needs order_col")
        g = cells.groupBy(row, col).agg(F.max_by(F.col(value), F.col(order_col)).alias(value))
    else:
        raise ValueError(on_duplicate)
    return g.groupBy(row).pivot(col, list(columns)).agg(F.first(value))


def coefficient_of_variation(sd, mean) -> Column:
    """[PV4] sigma / mu elementwise: 0/0 -> NaN, x/0 -> +inf (no ANSI divide error)."""
    sd = F.col(sd) if isinstance(sd, str) else sd
    mean = F.col(mean) if isinstance(mean, str) else mean
    return (F.when(mean != 0, sd / mean)
            .when(sd == 0, F.lit(float("nan")))
            .otherwise(F.lit(float("inf"))))


def row_label(model, size) -> Column:
    """[PV5] ``model (size)``; a missing size prints as ``---``."""
    return F.concat(F.col(model), F.lit(" ("), F.coalesce(F.col(size), F.lit(schemas.MISSING_CELL)), F.lit(")"))


def select_prompts(present: DataFrame, requested: Sequence[str], pid: str = "prompt_id") -> tuple[DataFrame, DataFrame]:
    """[PF15, SO2, SR4] Requested prompt list intersected with the present prompts, in request order
    (duplicates kept); and the requested ids that are absent."""
    spark = present.sparkSession
    req = spark.createDataFrame([(i, p) for i, p in enumerate(requested, 1)], f"req_ord int, {pid} string")
    have = present.select(pid).distinct()
    return req.join(have, pid, "left_semi"), req.join(have, pid, "left_anti")
