"""Generations under token budgets: what a larger budget changes for each item.

A reply is *answered* if it has content, *exhausted* if it has none because reasoning used the
whole budget, *silent* if it has none otherwise.  One item under two budgets is a pair of
states; pairs are found by one grouped pass over the responses, not by a self-join.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as tx

ANSWERED, EXHAUSTED, SILENT = "answered", "exhausted", "silent"
STATES = (ANSWERED, EXHAUSTED, SILENT)


def state(content: str = "content", thinking_tokens: str = "thinking_tokens", gen_tokens: str = "gen_tokens",
          budget: str = "budget") -> Column:
    """[TX13] State of one response from its content and its token counts."""
    spent = (F.col(thinking_tokens) > 0) & (F.col(gen_tokens) >= F.col(budget))
    return F.when(~tx.is_blank(F.coalesce(content, F.lit(""))), F.lit(ANSWERED)).when(spent, F.lit(EXHAUSTED)).otherwise(F.lit(SILENT))


def audit(responses: DataFrame, keys: Sequence[str] = ("model", "task")) -> DataFrame:
    """[TX13] Per group and budget: responses and how many are in each state."""
    s = responses.withColumn("state", state())
    return s.groupBy(*keys, "budget").agg(
        F.count(F.lit(1)).alias("n"), *[F.count_if(F.col("state") == x).alias(x) for x in STATES],
        F.sum("gen_tokens").alias("gen_tokens"))


def transitions(responses: DataFrame, small: int, large: int, item: Sequence[str] = ("model", "task", "item"),
                keys: Sequence[str] = ("model", "task")) -> DataFrame:
    """[TX13, JN9] Per group: items with a response under both budgets, and how they move from
    the small to the large one (``exhausted_to_answered`` and so on); items with one response
    only are counted apart.  The last response of an item and budget (by ``run_no``) counts."""
    s = responses.filter(F.col("budget").isin(small, large)).withColumn("state", state())
    pick = lambda b: F.max_by("state", F.when(F.col("budget") == b, F.col("run_no")))
    pairs = s.groupBy(*item).agg(pick(small).alias("_a"), pick(large).alias("_b"),
                                 F.count_if(F.col("budget") == small).alias("_na"), F.count_if(F.col("budget") == large).alias("_nb"))
    both = (F.col("_na") > 0) & (F.col("_nb") > 0)
    moves = [F.count_if(both & (F.col("_a") == a) & (F.col("_b") == b)).alias(f"{a}_to_{b}") for a in STATES for b in STATES]
    return pairs.groupBy(*keys).agg(F.count_if(both).alias("n_items"), F.count_if(~both).alias("n_unpaired"), *moves)
