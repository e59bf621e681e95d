"""Reconciling the names two tables give to one model.

A served name is a family and an optional tag (``family:tag``); file systems and scorers
write it in other cases and with other separators (``family__tag``, ``org/family``).  Two
names meet if they are equal after normalising; else by their family, if the name without a
tag stands for all of its quantisations; else on the longest common run of leading name
parts that ends where one of the names ends (``qwen3-coder`` meets ``qwen3-coder-30b``, never
``qwen3-c``).  Every step is an equi-join on exploded prefixes of distinct names, so no pair
of names is tried that shares no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.operators.runs import null_safe_join

SEPARATORS = r"[:/_\-\s]+"


def normal(name: str | Column) -> Column:
    """Lower case, ``__`` as ``:``, an organisation before ``/`` dropped, no outer space."""
    c = F.col(name) if isinstance(name, str) else name
    c = F.replace(F.lower(F.trim(c)), F.lit("__"), F.lit(":"))
    return F.regexp_replace(c, r"^[^/:]+/", "")


def family(key: Column) -> Column:
    return F.split(key, ":")[0]


def parts(key: Column) -> Column:
    return F.filter(F.split(key, SEPARATORS), lambda p: p != "")


def _prefixes(names: DataFrame, side: str) -> DataFrame:
    """name, key, n (parts), prefix, m (parts of the prefix)."""
    got = names.select(F.col("name").alias(side), normal("name").alias(f"{side}_key"))
    got = got.withColumn("_p", parts(F.col(f"{side}_key"))).withColumn(f"{side}_n", F.size("_p"))
    each = F.transform(F.sequence(F.lit(1), F.size("_p")), lambda m: F.struct(m.alias("m"), F.array_join(F.slice("_p", 1, m), " ").alias("prefix")))
    return got.filter(F.col(f"{side}_n") > 0).select(side, f"{side}_key", f"{side}_n", F.explode(each).alias("_x")) \
        .select(side, f"{side}_key", f"{side}_n", "_x.m", "_x.prefix")


def reconcile(left: DataFrame, left_col: str, right: DataFrame, right_col: str) -> DataFrame:
    """``left``, ``right``: each distinct left name and the right name it means.

    A right name may serve several left names (quantisations of one model); a left name has
    one right name: the best by rule (equal, family, longest prefix), then by name."""
    lp = _prefixes(left.select(F.col(left_col).alias("name")).distinct(), "left")
    rp = _prefixes(right.select(F.col(right_col).alias("name")).distinct(), "right")
    met = lp.join(rp, ["m", "prefix"]).filter((F.col("m") == F.col("left_n")) | (F.col("m") == F.col("right_n")))
    same = F.col("left_key") == F.col("right_key")
    kin = (family(F.col("left_key")) == family(F.col("right_key"))) & ~F.contains(F.col("right_key"), F.lit(":"))
    rule = F.when(same, F.lit(0)).when(kin, F.lit(1)).otherwise(F.lit(2))
    # two tagged names of one family are different models
    both = F.contains(F.col("left_key"), F.lit(":")) & F.contains(F.col("right_key"), F.lit(":"))
    met = met.withColumn("rule", rule).filter(same | ~both)
    best = Window.partitionBy("left").orderBy("rule", F.desc("m"), "right")
    return met.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1).select("left", "right")


def join_on_model(a: DataFrame, a_col: str, b: DataFrame, b_col: str) -> DataFrame:
    """[JN10] Full outer join of two per-model tables on the model both mean; rows of one side
    only keep nulls on the other.  ``model_key`` is the common (or own) normalised name."""
    link = reconcile(a, a_col, b, b_col)
    left = null_safe_join(a, link.select(F.col("left").alias(a_col), F.col("right").alias("_means")), [a_col], "left")
    right = b.withColumn("_own", F.col(b_col))
    j = left.join(right, F.col("_means") == F.col("_own"), "full")
    key = F.coalesce(normal(b_col), family(normal(a_col)))
    return j.withColumn("model_key", key).drop("_means", "_own")
