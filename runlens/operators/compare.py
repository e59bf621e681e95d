"""Re-scoring, pass@k, run comparison and audits over samples and outcome tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import outcomes as OC
from runlens.operators.cells import last_wins
from runlens.operators.runs import null_safe_join


def latest_outcomes(outcomes: DataFrame, keys: Sequence[str], order_col: str = "attempt",
                    passed: str = "passed") -> DataFrame:
    """[WN2] One outcome per key, the last attempt winning (aggregate, not a window)."""
    return last_wins(outcomes, keys, [passed], order_col)


def rescored(samples: DataFrame, outcomes: DataFrame, model_col: str = "model", id_col: str = "doc_id",
             pass_col: str = "pass_at_1") -> DataFrame:
    """[JN6] Every sample with two three-state flags: ``published`` (from its score) and
    ``rerun`` (its latest outcome; unknown without one).  Keys meet null-safely."""
    o = latest_outcomes(outcomes, [model_col, id_col])
    s = samples.select(model_col, id_col, OC.from_score(pass_col).alias("published"))
    return null_safe_join(s, o.withColumnRenamed("passed", "rerun"), [model_col, id_col], "left")


def rescore_summary(samples: DataFrame, outcomes: DataFrame, model_col: str = "model",
                    id_col: str = "doc_id", pass_col: str = "pass_at_1") -> DataFrame:
    """[AG7-AG9] Per model, rates over the samples whose published score is known:

    ``n`` all samples, ``n_known`` those with a published score, ``coverage`` their share;
    ``published`` passing in percent of them; ``corrected`` distinct ids that pass now, in
    percent of them (a scored sample without an outcome does not pass); ``n_rerun`` scored
    samples with an outcome; ``recovered`` fail -> pass, ``regressed`` pass -> not pass."""
    j = rescored(samples, outcomes, model_col, id_col, pass_col)
    was, now = F.col("published"), F.col("rerun")
    scored = was.isNotNull()
    passes = F.count_distinct(F.when(scored & now, F.col(id_col)))
    return j.groupBy(model_col).agg(
        F.count(F.lit(1)).alias("n"),
        OC.known(was).alias("n_known"),
        OC.coverage(was).alias("coverage"),
        OC.rate(was).alias("published"),
        F.when(OC.known(was) > 0, F.lit(100.0) * passes / OC.known(was)).alias("corrected"),
        F.count_if(scored & now.isNotNull()).alias("n_rerun"),
        OC.moved(was, now, OC.FAIL, OC.PASS).alias("recovered"),
        (OC.moved(was, now, OC.PASS, OC.FAIL) + OC.moved(was, now, OC.PASS, OC.UNKNOWN)).alias("regressed"),
    )


def pass_at_k_item(n: Column, c: Column, k: int) -> Column:
    """[AG11] Unbiased pass@k for one item with n attempts, c passing (Chen et al. 2021):
    1 when n - c < k, 0 when c = 0, else 1 - prod_{i=n-c+1..n} (1 - k / i).
    (``sequence`` counts down when start > stop, so c = 0 is handled explicitly.)"""
    prod = F.aggregate(F.sequence(n - c + 1, n), F.lit(1.0), lambda acc, i: acc * (F.lit(1.0) - F.lit(k) / i))
    return F.when(n - c < k, F.lit(1.0)).when(c == 0, F.lit(0.0)).otherwise(F.lit(1.0) - prod)


def pass_at_k(outcomes: DataFrame, item_col: str, ks: Sequence[int], passed: str = "passed",
              keys: Sequence[str] = ()) -> DataFrame:
    """[AG10, AG11, BS4] Mean pass@k over items (items with fewer than k attempts excluded), plus the
    number of items where any attempt passed."""
    items = outcomes.groupBy(*keys, item_col).agg(
        F.count(F.lit(1)).alias("n"), F.count_if(F.col(passed)).alias("c"),
        F.bool_or(F.col(passed)).alias("any_pass"))
    per_k = items.select(*keys, "n", "c", "any_pass", F.explode(F.array(*[F.lit(k) for k in ks])).alias("k"))
    est = F.when(F.col("k") == 0, F.lit(None))
    for k in ks:
        est = est.when(F.col("k") == k, pass_at_k_item(F.col("n"), F.col("c"), k))
    return (per_k.filter(F.col("n") >= F.col("k"))
            .groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("n_items"),
                                     F.count_if("any_pass").alias("items_any_pass"),
                                     F.avg(est).alias("pass_at_k")))


def empty_answers(samples: DataFrame, keys: Sequence[str], resps: str = "resps",
                  filtered: str = "filtered_resps") -> DataFrame:
    """[PF11, PF12, AG12] Per group: replies whose first leaf is blank, and the total."""
    leaf = tx.first_leaf(resps, filtered)
    return samples.groupBy(*keys).agg(F.count_if(tx.is_blank(leaf)).alias("n_empty"),
                                      F.count(F.lit(1)).alias("n_total"))


def fingerprinted(run: DataFrame, keys: Sequence[str], text_col: str, pass_col: str) -> DataFrame:
    """Keys, digest of the text and three-state flag of a run's items: what a comparison shuffles."""
    return run.select(*keys, F.sha2(F.col(text_col), 256).alias("digest"), F.col(pass_col).alias("passed"))


def run_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], text_col: str, pass_col: str,
             group: Sequence[str]) -> DataFrame:
    """[JN9] Compare two runs item by item: identical text (sha-256), fail -> pass, pass -> fail.

    The join is a null-safe full outer one on digests (texts are hashed where they lie), so
    items of one run only are counted too; a flip needs a known outcome on both sides."""
    ha, hb = (fingerprinted(x, keys, text_col, pass_col) for x in (a, b))
    return digest_diff(ha, hb, keys, group)


def digest_diff(a: DataFrame, b: DataFrame, keys: Sequence[str], group: Sequence[str]) -> DataFrame:
    """[JN9] :func:`run_diff` of two fingerprinted runs (keys, digest, passed)."""
    left = a.select(*keys, F.struct("digest", "passed").alias("_a"))
    right = b.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.struct("digest", "passed").alias("_b"))
    on = [F.col(k).eqNullSafe(F.col(f"_k_{k}")) for k in keys]
    j = left.join(right, on, "full")
    j = j.withColumns({k: F.when(F.col("_a").isNull(), F.col(f"_k_{k}")).otherwise(F.col(k)) for k in keys})
    both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
    was, now = F.col("_a.passed"), F.col("_b.passed")
    return j.groupBy(*group).agg(
        F.count_if(both).alias("n_items"),
        F.count_if(F.col("_b").isNull()).alias("only_a"),
        F.count_if(F.col("_a").isNull()).alias("only_b"),
        F.count_if(both & (F.col("_a.digest") == F.col("_b.digest"))).alias("identical"),
        OC.moved(was, now, OC.FAIL, OC.PASS).alias("flipped_up"),
        OC.moved(was, now, OC.PASS, OC.FAIL).alias("flipped_down"),
        F.count_if(both & (was.isNull() | now.isNull())).alias("unknown"),
    )


def accuracy(samples: DataFrame, model_col: str = "model", pass_col: str = "pass_at_1") -> DataFrame:
    """[AG7] Per model: samples, known outcomes and their pass rate in percent."""
    flag = OC.from_score(pass_col)
    return samples.groupBy(model_col).agg(
        F.count(F.lit(1)).alias("n_samples"), OC.known(flag).alias("n_known"), OC.rate(flag).alias("accuracy"))
