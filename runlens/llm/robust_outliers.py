"""Quality rules with robust multivariate outliers (DataFrame functions only).

Base statistics of a text are counted exactly.  Texts that pass the base rules are
described by a vector of transformed statistics; for every language and source the
minimum-covariance-determinant estimate of centre and scatter is found, and a text whose
Mahalanobis distance from its group's estimate is beyond the cut-off is rejected.

Estimate: two starts per group (coordinate-wise median and MAD; the half nearest the
median in the largest coordinate), concentration steps on the ``SUBSET`` share of rows
nearest under the current estimate until no group's determinant falls any more (quantiles
are sketches, so a fall below ``SETTLED`` counts as none; ``MAX_STEPS`` at most), and the
start with the smaller determinant wins.
Every step is one aggregate over all rows of all groups (moments and mergeable quantile
sketches, combined before the shuffle); per group only a few numbers are kept, so a
group holding a third of all rows is no task's burden.  Distances use a Cholesky factor
written out in columns.

Groups under ``MIN_ROWS`` rows are pooled by language, and what is still smaller is
pooled once more; a last pool under ``MIN_ROWS`` gives no verdict (its texts are kept).
Defined results: null text -> no words, all counts 0, base_failed, not kept; null
language or source -> a group of its own; repeated rows get equal verdicts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import SPACE, materialise

REPEAT_WINDOW, MIN_WORDS, MAX_REPEAT_PERCENT = 8, 20, 30
SUBSET, MAX_STEPS, SETTLED, MIN_ROWS, ACCURACY, SALTS = 0.75, 20, 1e-3, 50, 10_000, 64
#: Chi-square with seven degrees of freedom: its median, and the cut-off (upper 1e-6).
CHI2_MEDIAN, CHI2_CUT = 6.345811, 40.521828
#: Smallest standard deviation of each statistic: texts are not told apart below it.
FLOOR = {"x1": 0.70, "x2": 0.06, "x3": 0.15, "x4": 0.40, "x5": 0.10, "x6": 0.20, "x7": 0.20}
X = tuple(FLOOR)
P = len(X)


# ------------------------------------------------------------------- counts


def with_counts(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_distinct."""
    text = F.coalesce(F.col("text"), F.lit(""))
    d = docs.withColumn("__words", F.array_remove(F.split(text, SPACE), ""))
    d = d.withColumn("__lines", F.filter(F.split(text, "\n"), lambda x: x.rlike("[^\\x20\\x09-\\x0D]")))
    d = d.withColumn("n_words", F.size("__words").cast("long"))
    d = d.withColumn("word_chars", F.length(F.array_join("__words", "")).cast("long"))
    d = d.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, "#*$%&|<>", ""))).cast("long"))
    d = d.withColumn("n_lines", F.size("__lines").cast("long"))
    d = d.withColumn("n_dup_lines", (F.size("__lines") - F.size(F.array_distinct("__lines"))).cast("long"))
    d = d.withColumn("n_distinct", F.size(F.array_distinct("__words")).cast("long"))
    d = d.withColumn("__h", F.transform("__words", lambda w: F.xxhash64(w)))
    last = F.size("__h") - (REPEAT_WINDOW - 1)
    windows = F.transform(F.sequence(F.lit(1), last), lambda i: F.xxhash64(F.slice("__h", i, REPEAT_WINDOW)))
    d = d.withColumn("__win", F.when(last >= 1, windows).otherwise(F.array().cast("array<bigint>")))
    d = d.withColumn("__repeats", F.size("__win") > F.size(F.array_distinct("__win")))
    none = F.array().cast("array<struct<h:bigint,i:int>>")
    placed = F.array_sort(F.transform("__win", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    d = d.withColumn("__placed", F.when(F.col("__repeats"), placed).otherwise(none))
    twice = F.filter("__placed", lambda p, k: (F.get("__placed", k - 1)["h"] == p["h"]) | (F.get("__placed", k + 1)["h"] == p["h"]))
    d = d.withColumn("__at", F.array_sort(F.transform(twice, lambda p: p["i"])))
    start = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-REPEAT_WINDOW).alias("last"))
    covered = F.aggregate(
        "__at", start, lambda a, i: F.struct((a["n"] + F.least(F.lit(REPEAT_WINDOW), i - a["last"])).alias("n"), i.alias("last")), lambda a: a["n"]
    )
    d = d.withColumn("n_repeat_words", covered)
    return d.drop("__words", "__lines", "__h", "__win", "__repeats", "__placed", "__at")


def base_failed() -> Column:
    return (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * MAX_REPEAT_PERCENT)


def statistics() -> dict[str, Column]:
    """The transformed statistic vector of a text with words (without: null)."""
    n = F.when(F.col("n_words") > 0, F.col("n_words").cast("double"))
    return {
        "x1": F.log(n),
        "x2": F.log(F.col("word_chars") / n),
        "x3": F.log(F.col("n_distinct") / n),
        "x4": F.log1p(n / F.greatest(F.col("n_lines"), F.lit(1))),
        "x5": F.sqrt(F.col("n_symbols") / n),
        "x6": F.sqrt(F.col("n_dup_lines") / F.greatest(F.col("n_lines"), F.lit(1)) + n * 0),
        "x7": F.sqrt(F.col("n_repeat_words") / n),
    }


# ------------------------------------------------------------------ estimates


def with_pool(rows: DataFrame, min_rows: int) -> DataFrame:
    """Adds ``pool``: language and source, or what its small groups are pooled into."""
    keys = [F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"}), F.to_json(F.struct("lang"), {"ignoreNullFields": "false"}), F.lit("all")]
    out = rows.withColumn("pool", keys[0])
    for coarser in keys[1:]:
        size = out.groupBy("pool").agg(F.count(F.lit(1)).alias("__n"))
        small = materialise(size.filter(F.col("__n") < min_rows).select(F.col("pool").alias("__small")), "mcd-small")
        out = out.join(small, F.col("pool") == F.col("__small"), "left")
        out = out.withColumn("pool", F.when(F.col("__small").isNotNull(), coarser).otherwise(F.col("pool"))).drop("__small")
    return out


def _factor(est: DataFrame) -> DataFrame:
    """Adds the Cholesky factor l_ij of the covariance c_ij and its log determinant."""
    for i in range(P):
        for j in range(i + 1):
            rest = F.col(f"c{i}{j}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            value = F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}")
            est = est.withColumn(f"l{i}{j}", value)
    return est.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in range(P)), F.lit(0.0)))


def _distance() -> Column:
    """Squared Mahalanobis distance by forward substitution."""
    y: list[Column] = []
    for i, x in enumerate(X):
        rest = F.col(x) - F.col(f"m{i}")
        for k in range(i):
            rest = rest - F.col(f"l{i}{k}") * y[k]
        y.append(rest / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


def _beside(rows: DataFrame, est: DataFrame) -> DataFrame:
    """Rows with their group's numbers.  A group's rows are dealt over ``SALTS`` keys, so a
    large one is spread out also where the numbers are too many to be broadcast."""
    salted = rows.withColumn("salt", F.pmod(F.xxhash64(*X), F.lit(SALTS)).cast("int"))
    return salted.join(est.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["pool", "salt"]).drop("salt")


def _moments() -> list[Column]:
    out = [F.count(F.lit(1)).alias("n")] + [F.avg(x).alias(f"m{i}") for i, x in enumerate(X)]
    for i, a in enumerate(X):
        for j, b in enumerate(X[: i + 1]):
            c = F.covar_pop(a, b)
            out.append((c + FLOOR[a] ** 2 if i == j else c).alias(f"c{i}{j}"))
    return out


def _nearest(rows: DataFrame, est: DataFrame, name: str) -> DataFrame:
    """Moments of the SUBSET share of each group's rows nearest under each estimate."""
    near = _beside(rows, est).withColumn("d2", _distance())
    cut = near.groupBy("pool", "start").agg(F.percentile_approx("d2", F.lit(SUBSET), F.lit(ACCURACY)).alias("cut"))
    est = materialise(est.join(cut, ["pool", "start"]), f"mcd-cut-{name}")
    near = _beside(rows, est).withColumn("d2", _distance()).filter(F.col("d2") <= F.col("cut"))
    return materialise(_factor(near.groupBy("pool", "start").agg(*_moments())), f"mcd-{name}")


def estimates(rows: DataFrame) -> DataFrame:
    """pool, centre m_i, factor l_ij and cut-off of every pool; ``rows`` has pool and X."""
    med = rows.groupBy("pool").agg(*[F.percentile_approx(x, F.lit(0.5), F.lit(ACCURACY)).alias(f"m{i}") for i, x in enumerate(X)])
    med = materialise(med, "mcd-median")
    dev = _beside(rows, med)
    mad = dev.groupBy("pool").agg(*[F.percentile_approx(F.abs(F.col(x) - F.col(f"m{i}")), F.lit(0.5), F.lit(ACCURACY)).alias(f"s{i}") for i, x in enumerate(X)])
    scale = [F.pow(F.col(f"s{i}") * 1.4826, 2) + FLOOR[x] ** 2 for i, x in enumerate(X)]
    start = med.join(mad, "pool").select(
        "pool", *[f"m{i}" for i in range(P)], *[(scale[i] if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in range(P) for j in range(i + 1)]
    )
    start = materialise(_factor(start), "mcd-start")
    # second start: moments of the half whose largest standardised coordinate is smallest
    far = _beside(rows, start)
    far = far.withColumn("far", F.greatest(*[F.abs(F.col(x) - F.col(f"m{i}")) / F.col(f"l{i}{i}") for i, x in enumerate(X)]))
    half = materialise(far.groupBy("pool").agg(F.percentile_approx("far", F.lit(0.5), F.lit(ACCURACY)).alias("half")), "mcd-half")
    other = _beside(far, half).filter(F.col("far") <= F.col("half")).groupBy("pool").agg(*_moments())
    keep = ["pool", *[f"m{i}" for i in range(P)], *[f"l{i}{j}" for i in range(P) for j in range(i + 1)]]
    est = start.select(F.lit(0).alias("start"), *keep).unionByName(_factor(other).select(F.lit(1).alias("start"), *keep))
    est = materialise(est, "mcd-starts")
    est = _nearest(rows, est, "step0")
    for step in range(1, MAX_STEPS):
        new = _nearest(rows, est.select("start", *keep), f"step{step}")
        old = est.select(F.col("pool").alias("p"), F.col("start").alias("s"), F.col("logdet").alias("was"))
        fall = new.join(old, (F.col("p") == F.col("pool")) & (F.col("s") == F.col("start"))).agg(F.max(F.col("was") - F.col("logdet"))).first()[0]
        est = new
        if fall is None or fall < SETTLED:
            break
    best = est.groupBy("pool").agg(F.min_by("start", F.struct("logdet", "start")).alias("start"))
    est = materialise(est.join(best, ["pool", "start"]).select(*keep), "mcd-best")
    # consistency: the median distance of all rows of the group is that of the chi-square
    d2 = _beside(rows, est).withColumn("d2", _distance()).groupBy("pool")
    scale = d2.agg(F.count(F.lit(1)).alias("rows"), F.percentile_approx("d2", F.lit(0.5), F.lit(ACCURACY)).alias("median"))
    cut = F.greatest(F.col("median") / CHI2_MEDIAN, F.lit(1.0)) * CHI2_CUT
    return materialise(est.join(scale, "pool").withColumn("cutoff", cut), "mcd-estimates")


def quality(docs: DataFrame, min_rows: int = MIN_ROWS) -> DataFrame:
    """doc_id, the base counts, base_failed, kept, distance of every row of ``docs``
    (doc_id, text, lang, source)."""
    rows = with_counts(docs.select("doc_id", "text", "lang", "source")).drop("text")
    rows = materialise(rows.withColumn("base_failed", base_failed()), "mcd-counts")
    good = rows.filter(~F.col("base_failed")).select("lang", "source", *[c.alias(x) for x, c in statistics().items()])
    good = materialise(with_pool(good, min_rows), "mcd-rows")
    est = estimates(good)
    verdict = est.filter(F.col("rows") >= min_rows)
    # the pools of the rows again: small groups were replaced, so look up from fine to coarse
    fine = F.to_json(F.struct("lang", "source"), {"ignoreNullFields": "false"})
    mid = F.to_json(F.struct("lang"), {"ignoreNullFields": "false"})
    pools = good.select("pool").distinct()
    names = materialise(pools, "mcd-pools")
    out = rows.withColumn("__fine", fine).withColumn("__mid", mid)
    out = out.join(names.select(F.col("pool").alias("__f")), F.col("__fine") == F.col("__f"), "left")
    out = out.join(names.select(F.col("pool").alias("__m")), F.col("__mid") == F.col("__m"), "left")
    out = out.withColumn("pool", F.coalesce("__f", "__m", F.lit("all"))).withColumns(statistics())
    out = out.join(verdict, "pool", "left").withColumn("distance", F.when(~F.col("base_failed"), _distance() / F.col("cutoff")))
    kept = ~F.col("base_failed") & F.coalesce(F.col("distance") <= 1.0, F.lit(True))
    return out.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", kept.alias("kept"), F.sqrt("distance").alias("distance")
    )
