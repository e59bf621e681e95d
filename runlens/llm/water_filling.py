"""Mixing sources to target weights by capped water-filling.

Each source gets ``weight / sum of weights`` of the budget, but never more than
``max_epochs`` times its own words; what a capped source cannot take is shared among the
others by weight until none is above its cap.  The level is found in closed form: with
sources in order of cap/weight, the first one whose share of the rest stays below its
cap fixes the level of it and all later ones.

A source with target ``e`` epochs takes every document ``floor(e)`` times as a whole.
The fractional repetition takes documents in the order of a seeded hash until the
source's remaining words are met; the document on the edge gives the words still
missing.  Which documents those are follows from one threshold per source, found from
sums over hash buckets (aggregated before the shuffle) and an exact pass over the one
bucket that holds the edge; no source is gathered or sorted as a whole.

Defined results: null source -> a source of its own, last; null text -> size 0; a source
without words has target 0; rows equal in hash, size and text share the edge equally
(rounded down); an empty table gives an empty mix.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import SPACE, materialise, unused

SEED, BUCKET_DIGITS = 20240, 3
WEIGHTS, BUDGET, MAX_EPOCHS = (3, 1, 2), 1.5, 2


def n_words(text: Column) -> Column:
    words = F.split(F.coalesce(text, F.lit("")), SPACE)
    return F.size(F.filter(words, lambda w: w != "")).cast("long")


def _place(seed: int, size: str) -> Column:
    """Seeded place of a row: hash of its id and text, so rows without an id or with one id
    are spread over the buckets too; then its size."""
    body = F.md5(F.coalesce("text", F.lit("")).cast("binary"))
    salt = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), body)
    return F.struct(F.md5(salt.cast("binary")).alias("key"), F.col(size).alias("size"))


def targets(sizes: DataFrame, weights=WEIGHTS, budget: float = BUDGET, max_epochs: float = MAX_EPOCHS) -> DataFrame:
    """source, source_size, weight, target.  ``sizes`` has one row per source; the windows
    below see that table only."""
    all_rows = Window.partitionBy()
    nth = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    s = sizes.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), F.pmod(nth, F.lit(len(weights))).cast("int") + 1))
    s = s.withColumn("cap", F.col("source_size").cast("double") * max_epochs).withColumn("ratio", F.col("cap") / F.col("weight"))
    by = Window.orderBy("ratio", F.col("source").asc_nulls_last())
    s = s.withColumn("given", F.sum("cap").over(by.rowsBetween(Window.unboundedPreceding, 0)) - F.col("cap"))
    s = s.withColumn("rest", F.sum("weight").over(by.rowsBetween(0, Window.unboundedFollowing)))
    s = s.withColumn("level", (F.sum("source_size").over(all_rows) * F.lit(float(budget)) - F.col("given")) / F.col("rest"))
    free = F.when(F.col("level") < F.col("ratio"), F.col("level"))
    s = s.withColumn("water", F.first(free, ignorenulls=True).over(by.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)))
    return s.select("source", "source_size", "weight", F.least("cap", F.coalesce(F.col("water") * F.col("weight"), F.col("cap"))).alias("target"))


def thresholds(docs: DataFrame, seed: int = SEED, **mixing) -> DataFrame:
    """One row per source: source, source_size, target, whole (repetitions of all of it),
    edge (place of the row on the edge, null if none) and edge_words (words it gives)."""
    rows = docs.select("source", n_words(F.col("text")).alias("size"), "doc_id", "text")
    rows = materialise(rows.select("source", "size", _place(seed, "size").alias("at")), "mix-sizes")
    plan = targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), **mixing)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("quota", F.round(F.col("target") - F.col("whole") * F.col("source_size")).cast("long"))
    plan = materialise(plan, "mix-plan")
    rows = rows.withColumn("bucket", F.substring("at.key", 1, BUCKET_DIGITS))
    sums = rows.groupBy("source", "bucket").agg(F.sum("size").alias("words"))
    upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    sums = sums.withColumn("before", F.sum("words").over(upto) - F.col("words"))
    sums = sums.withColumnRenamed("source", "src")
    same = F.col("src").eqNullSafe(F.col("source"))
    edge = plan.join(sums, same).filter((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("words")))
    edge = materialise(edge.select("src", F.col("bucket").alias("edge_bucket"), "before", "quota"), "mix-edge")
    near = rows.join(edge, F.col("src").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("edge_bucket")))
    near = near.groupBy("src", "at").agg(F.count(F.lit(1)).alias("n"), F.first("size").alias("size"), F.first("before").alias("before"), F.first("quota").alias("quota"))
    upto = Window.partitionBy("src").orderBy("at").rowsBetween(Window.unboundedPreceding, 0)
    near = near.withColumn("words", F.col("n") * F.col("size"))
    near = near.withColumn("before", F.col("before") + F.sum("words").over(upto) - F.col("words"))
    near = near.filter((F.col("before") < F.col("quota")) & (F.col("quota") <= F.col("before") + F.col("words")))
    near = near.select("src", F.col("at").alias("edge"), F.floor((F.col("quota") - F.col("before")) / F.col("n")).alias("edge_words"))
    got = plan.join(near, same, "left").select("source", "source_size", "target", "whole", "edge", "edge_words")
    return materialise(got, "mix-thresholds")


def mix(docs: DataFrame, seed: int = SEED, name: str = "__mix", **mixing) -> DataFrame:
    """``docs`` with a struct column ``name``: size, source_size, target, whole (whole
    repetitions) and part (words of the fractional repetition)."""
    size, at, src, of = unused(docs.withColumn(name, F.lit(0)), "__size", "__at", "__src", "__plan")
    plan = thresholds(docs, seed, **mixing).withColumnRenamed("source", src)
    plan = plan.select(src, F.struct("source_size", "target", "whole", "edge", "edge_words").alias(of))
    got = docs.withColumn(size, n_words(F.col("text")))
    got = got.withColumn(at, _place(seed, size)).join(plan, F.col(src).eqNullSafe(F.col("source")), "left")
    edge = F.col(of)["edge"]
    part = F.when(F.col(at) < edge, F.col(size)).when(F.col(at) == edge, F.col(of)["edge_words"]).otherwise(F.lit(0))
    out = F.struct(
        F.col(size).alias("size"), F.col(of)["source_size"].alias("source_size"), F.col(of)["target"].alias("target"),
        F.col(of)["whole"].alias("whole"), part.cast("long").alias("part"),
    )
    return got.withColumn(name, out).drop(size, at, src, of)


def mixed_documents(docs: DataFrame, seed: int = SEED, **mixing) -> DataFrame:
    """The mix itself: every row as often as it is taken, with the columns of ``docs``.
    Texts stay whole: the edge document's last repetition is written if at least half of
    its words are taken."""
    name, copy = unused(docs, "__mix", "__copy")
    got = mix(docs, seed, name, **mixing)
    m = F.col(name)
    copies = m["whole"] + ((m["part"] > 0) & (m["part"] * 2 >= m["size"])).cast("long")
    got = got.withColumn(copy, F.explode(F.array_repeat(F.lit(True), copies.cast("int"))))
    return got.drop(name, copy)


def mixture(docs: DataFrame) -> DataFrame:
    """doc_id, size, source_size, target, taken of every row of ``docs`` (doc_id, source, text)."""
    got = mix(docs.select("doc_id", "source", "text"))
    m = F.col("__mix")
    return got.select("doc_id", m["size"].alias("size"), m["source_size"].alias("source_size"), m["target"].alias("target"), (m["whole"] * m["size"] + m["part"]).alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS k
  FROM documents),
src AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         [3, 1, 2][1 + (row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3] AS w
  FROM sized GROUP BY source),
lev AS (
  SELECT *, 2.0 * source_size / w AS ratio,
         (1.5 * sum(source_size) OVER () - (sum(2.0 * source_size) OVER o - 2.0 * source_size))
           / (sum(w) OVER () - (sum(w) OVER o - w)) AS level
  FROM src WINDOW o AS (ORDER BY 2.0 * source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
plan AS (
  SELECT source, source_size,
         least(CAST(2.0 * source_size AS DOUBLE), CAST((SELECT max(level) FROM (SELECT arg_min(level, ratio) AS level FROM lev WHERE level < ratio)) * w AS DOUBLE)) AS target
  FROM lev),
quota AS (
  SELECT *, CAST(CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS BIGINT) AS whole FROM plan),
cum AS (
  SELECT s.*, q.source_size, q.target, q.whole, CAST(round(q.target - q.whole * q.source_size) AS BIGINT) AS quota,
         count(*) OVER p AS n, CAST(sum(size) OVER o AS BIGINT) AS upto
  FROM sized s JOIN quota q ON s.source IS NOT DISTINCT FROM q.source
  WINDOW p AS (PARTITION BY s.source, k, size), o AS (PARTITION BY s.source ORDER BY k, size))
SELECT doc_id, size, source_size, target,
       whole * size + CAST(floor(least(greatest(quota - (upto - n * size), 0), n * size) / n) AS BIGINT) AS taken
FROM cum
"""
