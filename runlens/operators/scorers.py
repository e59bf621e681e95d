"""Benchmark scorers over generated text, as Spark jobs.

Numeric exact match (grade-school arithmetic, Cobbe et al. 2021), ROUGE-1
(Lin 2004) and BLEU (Papineni et al. 2002) are counted inside the row of each pair
against its reference's grams, so no n-gram of the corpus is shuffled.  A small registry maps metric names to Column functions.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A number: optional sign and $, digits with thousands commas, optional decimals.
NUMBER = r"-?\$?[0-9][0-9,]*(?:\.[0-9]+)?"
# Word tokens for overlap scores: runs of letters/digits, lower-cased.
TOKEN_SPLIT = r"[^\p{L}\p{N}]+"


def last_number(text) -> Column:
    """Last number in the text with ``$`` and ``,`` removed and a final ``.`` dropped."""
    c = F.col(text) if isinstance(text, str) else text
    found = F.regexp_extract_all(c, F.lit(NUMBER), 0)
    last = F.try_element_at(found, F.lit(-1))
    clean = F.regexp_replace(F.regexp_replace(last, r"[$,]", ""), r"\.$", "")
    return clean


def numeric_match(pred, gold) -> Column:
    """[BS1] Exact match of the parsed last number against the gold number."""
    p = last_number(pred).try_cast("decimal(38,10)")
    g = (F.col(gold) if isinstance(gold, str) else gold).try_cast("decimal(38,10)")
    return F.coalesce(p == g, F.lit(False))


def tokens(text) -> Column:
    c = F.col(text) if isinstance(text, str) else text
    return F.array_remove(F.split(F.lower(c), TOKEN_SPLIT), "")


def _gram_arrays(t: Column, max_n: int) -> list[Column]:
    """The n-grams (n = 1..max_n) of a token array, each order built from the one before by
    one concatenation per gram."""
    out = [t]
    for n in range(2, max_n + 1):
        m = F.greatest(F.size(t) - n + 1, F.lit(0))
        out.append(F.zip_with(F.slice(out[-1], 1, m), F.slice(t, n, m), lambda a, b: F.concat_ws(" ", a, b)))
    return out


def _occurrences(grams: Column, distinct: Column) -> Column:
    """How often the array ``grams`` holds each of ``distinct``; null where they are."""

    @F.pandas_udf("array<int>")
    def counts(every: pd.Series, wanted: pd.Series) -> pd.Series:
        return pd.Series([None if g is None else [*map(Counter(g).__getitem__, d)] for g, d in zip(every, wanted, strict=True)], dtype=object)

    return counts(grams, distinct)


def gram_table(refs: DataFrame, key: Sequence[str], text: str, max_n: int) -> DataFrame:
    """One row a reference: its key, ``r_len`` (tokens), and per order n the distinct grams
    ``g<n>`` beside their counts ``c<n>``.  A reference is counted inside its own row, in one pass
    per order."""
    t = refs.select(*key, tokens(text).alias("_t")).withColumn("r_len", F.size("_t"))
    for n, grams in enumerate(_gram_arrays(F.col("_t"), max_n), start=1):
        t = t.withColumn(f"_a{n}", grams)
    for n in range(1, max_n + 1):
        t = t.withColumn(f"g{n}", F.array_distinct(f"_a{n}"))
        t = t.withColumn(f"c{n}", _occurrences(F.col(f"_a{n}"), F.col(f"g{n}")))
    return t.drop("_t", *[f"_a{n}" for n in range(1, max_n + 1)])


def _clipped(words: list[str], tables: list[dict[str, int]]) -> list[int]:
    """Clipped matches per order with a reference's gram counts.  A gram can match only where
    the one a word shorter did, so each order looks at no more places than the one before."""
    at, out = enumerate(words), []
    for n, table in enumerate(tables, start=1):
        at = [(i, g) for i, g in at if g in table]
        seen = Counter(g for _, g in at)
        out.append(sum(min(k, table[g]) for g, k in seen.items()))
        at = [(i, f"{g} {words[i + n]}") for i, g in at if i + n < len(words)]
    return out


def clipped_matches(pairs: DataFrame, toks: str, max_n: int) -> DataFrame:
    """Adds ``m1..m<max_n>``: the clipped n-gram matches of the token array ``toks`` (words
    without spaces, as :func:`tokens` makes them) with the reference grams of the same row
    (:func:`gram_table`); 0 where either side is null.

    Counting stays inside the row, one hash lookup a token; nothing is shuffled by gram.  The
    tokens reach the workers as one string a row, since a batch of strings takes less memory
    there than one of token lists."""

    @F.pandas_udf("array<int>")
    def matches(text: pd.Series, *table: pd.Series) -> pd.Series:
        out = []
        for words, *t in zip(text, *table, strict=True):
            whole = words is not None and all(x is not None for x in t)
            out.append(_clipped(words.split(" "), [dict(zip(*x, strict=True)) for x in zip(t[:max_n], t[max_n:], strict=True)]) if whole else [0] * max_n)
        return pd.Series(out)

    orders = range(1, max_n + 1)
    rows = pairs.withColumn("_m", matches(F.array_join(toks, " "), *[f"g{n}" for n in orders], *[f"c{n}" for n in orders]))
    return rows.withColumns({f"m{n}": F.col("_m")[n - 1] for n in orders}).drop("_m")


def _ratio(a: Column, b: Column) -> Column:
    return F.when(b > 0, a / b).otherwise(F.lit(0.0))


def rouge1_rows(pairs: DataFrame, toks: str = "toks") -> DataFrame:
    """[BS2] Adds ``rouge1`` (F1 of unigram overlap) to rows that hold a token array and a
    reference's grams."""
    rows = clipped_matches(pairs, toks, 1)
    p, r = _ratio(F.col("m1"), F.size(toks)), _ratio(F.col("m1"), F.col("r_len"))
    return rows.withColumn("rouge1", F.when(p + r > 0, F.lit(2.0) * p * r / (p + r)).otherwise(F.lit(0.0)))


def bleu_rows(pairs: DataFrame, toks: str = "toks", max_n: int = 4) -> DataFrame:
    """[BS3] Adds ``bleu`` to rows that hold a token array and a reference's grams: clipped
    precisions for n = 1..max_n, add-one smoothing for n > 1 (Lin & Och 2004), geometric mean,
    brevity penalty exp(1 - r/c) when c < r; 0 without a shared unigram."""
    rows = clipped_matches(pairs, toks, max_n).withColumn("c_len", F.size(toks))
    logs = []
    for n in range(1, max_n + 1):
        m = F.col(f"m{n}").cast("double")
        t = F.greatest(F.col("c_len") - n + 1, F.lit(0)).cast("double")
        prec = (m / t) if n == 1 else ((m + 1) / (t + 1))
        logs.append(F.when(prec > 0, F.log(prec)))
    mean_log = sum(logs[1:], logs[0]) / F.lit(float(max_n))
    bp = F.when(F.col("c_len") >= F.col("r_len"), F.lit(1.0)).when(
        F.col("c_len") > 0, F.exp(F.lit(1.0) - F.col("r_len") / F.col("c_len"))).otherwise(F.lit(0.0))
    return rows.withColumn("bleu", F.when(F.col("m1") == 0, F.lit(0.0)).otherwise(bp * F.exp(mean_log)))


def _paired(pairs: DataFrame, pred_key: Sequence[str], ref_key: Sequence[str], preds: DataFrame, pred_text: str,
            refs: DataFrame, ref_text: str, max_n: int) -> DataFrame:
    toks = preds.select(*pred_key, tokens(pred_text).alias("toks"))
    return pairs.join(gram_table(refs, ref_key, ref_text, max_n), list(ref_key)).join(toks, list(pred_key))


def _only(rows: DataFrame, pairs: DataFrame, score: str) -> DataFrame:
    return rows.select(*pairs.columns, score)


def rouge1(pairs: DataFrame, pred_key: Sequence[str], ref_key: Sequence[str],
           preds: DataFrame, pred_text: str, refs: DataFrame, ref_text: str) -> DataFrame:
    """[BS2] ROUGE-1 F1 for every (prediction, reference) pair listed in ``pairs``.  Where the
    prediction rows can carry their pairs themselves, :func:`rouge1_rows` saves the join."""
    return _only(rouge1_rows(_paired(pairs, pred_key, ref_key, preds, pred_text, refs, ref_text, 1)), pairs, "rouge1")


def bleu(pairs: DataFrame, pred_key: Sequence[str], ref_key: Sequence[str],
         preds: DataFrame, pred_text: str, refs: DataFrame, ref_text: str, max_n: int = 4) -> DataFrame:
    """[BS3] Sentence BLEU per pair with one reference (see :func:`bleu_rows`)."""
    return _only(bleu_rows(_paired(pairs, pred_key, ref_key, preds, pred_text, refs, ref_text, max_n), max_n=max_n), pairs, "bleu")


# ---------------------------------------------------------------------------
# Metric registry (user metric functions referenced by name, aggregated by mean)
# ---------------------------------------------------------------------------

METRICS: dict[str, Callable[..., Column]] = {}


def metric(name: str):
    def deco(fn: Callable[..., Column]):
        METRICS[name] = fn
        return fn
    return deco


@metric("exact_match")
def _exact(pred: str, gold: str) -> Column:
    return (F.col(pred) == F.col(gold)).cast("double")


@metric("numeric_match")
def _numeric(pred: str, gold: str) -> Column:
    return numeric_match(pred, gold).cast("double")


@metric("passed")
def _passed(passed: str) -> Column:
    return F.col(passed).cast("double")


def score(df: DataFrame, task: dict, keys: Sequence[str] = ()) -> DataFrame:
    """[UD1, UD2] Apply a task definition: optional response filter chain, then the named metric
    aggregated by mean.  ``task`` may ``include`` a base task whose keys it overrides."""
    t = resolve(task)
    for flt in t.get("filters", []):
        df = df.transform(flt)
    col = METRICS[t["metric"]](*t["args"])
    g = df.groupBy(*keys) if keys else df.groupBy()
    return g.agg(F.avg(col).alias(t.get("name", t["metric"])), F.count(F.lit(1)).alias("n"))


def resolve(task: dict) -> dict:
    """[UD3] Config inheritance: ``include`` a base dict, overriding keys win."""
    base = task.get("include")
    if base is None:
        return dict(task)
    merged = resolve(base)
    merged.update({k: v for k, v in task.items() if k != "include"})
    return merged
