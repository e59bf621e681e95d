"""Importance resampling of documents towards a target text set by hashed n-grams.

Scanning: A-Z are lower-cased, every run of separator bytes becomes one space, and a
``regex`` pattern per order with boundary lookarounds, searched with ``overlapped=True``,
emits the span of every run of 1 to ``ORDERS`` words; the CRC-32 of the span's bytes modulo
``BUCKETS`` is the feature.  Nothing is split into words and joined again.

The texts are scanned once: a task writes each text's buckets (two bytes a feature) and one
row of counts for itself; the counts of all documents and of all target texts are sums of
these rows.  A bucket's gain is the smoothed log ratio of the two distributions, a text's
weight the sum over its features, its score the weight plus seeded Gumbel noise, so the
highest scores are a draw without replacement in proportion to the weights.  The draw ranks
(score, id) pairs in range partitions; no set of scores is gathered.

Defined results: a null or wordless text has no feature, weight 0, and is never drawn; a null
id has the noise of the empty id and stands last among ties; rows equal in score and id rank
in any order (they are alike in all that is returned up to their features, which break the
tie); without target texts (or without documents) the smoothed gains hold all the same.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.common import CRC_TABLE, crc32_sql, materialise
from runlens.operators.cells import ranked

ORDERS, BUCKETS, SEED = 3, 10_000, 42
MIN_WORDS, DRAWN_PERCENT = 20, 5
#: Bytes of words, lower-cased; all other bytes separate.
_KEPT = bytes(range(0x30, 0x3A)) + bytes(range(0x61, 0x7B)) + bytes(range(0x80, 0x100))
_CLEAN = bytes(b if b in _KEPT else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
# a span starts behind a space (``\K`` forgets it: a look-behind that the scanner can seek) and ends before one
_RUNS = [regex.compile(rb" \K" + b" ".join([rb"[^ ]++"] * k) + rb"(?= )") for k in range(1, ORDERS + 1)]


def normal(text: bytes) -> bytes:
    """The words of a text, one space before, between and behind them."""
    return b" %b " % b" ".join(text.translate(_CLEAN).split())


def spans(clean: bytes) -> Iterator[tuple[int, int]]:
    """Spans of all n-grams of a normal text, order by order."""
    for run in _RUNS:
        for m in run.finditer(clean, overlapped=True):
            yield m.span()


def buckets(text: bytes, n: int = BUCKETS) -> tuple[int, np.ndarray]:
    """Number of words, and the bucket of every feature."""
    clean, crc = normal(text), zlib.crc32
    got = [np.fromiter((crc(m[0]) for m in run.finditer(clean, overlapped=True)), np.uint32) for run in _RUNS]
    return len(got[0]), (np.concatenate(got) % np.uint32(n)).astype(np.uint16)


# ------------------------------------------------------------------ Spark side


def scanned(docs: DataFrame, id_col: str, n: int = BUCKETS) -> DataFrame:
    """One row a text (id, n_words, grams) and one row a task (counts), written once.

    ``grams`` are the buckets and ``counts`` the sums over the task's texts, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, schema = np.zeros(n, np.int64), None
        for b in batches:
            texts = b.column(1).cast(pa.binary())
            for lo in range(0, b.num_rows, 256):
                done = [buckets(t.as_py() or b"", n) for t in texts.slice(lo, 256)]
                for _, at in done:
                    total += np.bincount(at, minlength=n)
                cols = [
                    b.column(0).slice(lo, 256), pa.array([w for w, _ in done], pa.int64()),
                    pa.array([at.astype("<u2").tobytes() for _, at in done], pa.binary()), pa.nulls(len(done), pa.binary()),
                ]
                schema = schema or pa.schema([pa.field(c, x.type) for c, x in zip(("id", "n_words", "grams", "counts"), cols, strict=True)])
                yield pa.RecordBatch.from_arrays(cols, schema=schema)
        if schema is not None:
            one = [pa.nulls(1, f.type) for f in schema]
            one[3] = pa.array([total.astype("<i8").tobytes()], pa.binary())
            yield pa.RecordBatch.from_arrays(one, schema=schema)

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col("text").cast("string").alias("text"))
    return materialise(rows.mapInArrow(run, f"id {kind}, n_words long, grams binary, counts binary"), "resample-grams")


def bucket_counts(scan: DataFrame, n: int = BUCKETS) -> np.ndarray:
    """Features of all texts in each bucket: one partial sum a task, ``n`` rows in the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(n, np.int64)
        for b in batches:
            for c in b.column(0):
                total += np.frombuffer(c.as_py(), "<i8")
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(n, dtype=np.int32)), pa.array(total)], names=["bucket", "count"])

    parts = scan.select("counts").filter(F.col("counts").isNotNull()).mapInArrow(run, "bucket int, count long")
    out = np.zeros(n, np.int64)
    for r in parts.groupBy("bucket").agg(F.sum("count").alias("count")).collect():  # at most n rows
        out[r["bucket"]] = r["count"]
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 * ln) of the ratio of the smoothed shares of each bucket, in doubles."""
    n, s, t = len(source), source.astype(float), target.astype(float)
    ratio = (t + 1) * (float(source.sum()) + n) / ((s + 1) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weighted(scan: DataFrame, gain: np.ndarray) -> DataFrame:
    """id, n_words, n_features, weight of every scanned text."""

    @F.pandas_udf("struct<n_features:long,weight:long>")
    def weigh(grams):
        import pandas as pd

        at = [np.frombuffer(g, "<u2") for g in grams]
        return pd.DataFrame({"n_features": [len(a) for a in at], "weight": [int(gain[a].sum()) for a in at]})

    got = scan.filter(F.col("counts").isNull()).select("id", "n_words", weigh("grams").alias("w"))
    return got.select("id", "n_words", "w.n_features", "w.weight")


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths, from the first 32 bits of the id's seeded hash."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256)
    h = F.conv(F.substring(digest, 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.ln(-F.ln((h + 0.5) / F.lit(4294967296.0))))


def resample(
    docs: DataFrame, target: DataFrame, percent: int = DRAWN_PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, n: int = BUCKETS
) -> DataFrame:
    """doc_id, n_features, weight, score and rank (null if not drawn) of every row of ``docs``
    (doc_id, text), drawn towards the texts of ``target`` (text)."""
    scan = scanned(docs, "doc_id", n)
    aim = scanned(target.withColumn("id", F.lit(0)), "id", n)
    gain = gains(bucket_counts(scan, n), bucket_counts(aim, n))
    rows = weighted(scan, gain).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    rows = materialise(rows.withColumn("down", -F.col("score")).withColumn("late", F.col("id").isNull()), "resample-scores")
    able = F.col("n_words") >= min_words
    drawn = rows.filter(able).count() * percent // 100
    placed = ranked(rows.filter(able), [], ["down", "late", "id", "n_features"], "place")
    placed = placed.withColumn("rank", F.when(F.col("place") < drawn, F.col("place") + 1))
    rest = rows.filter(~able).withColumn("rank", F.lit(None).cast("long"))
    cols = [F.col("id").alias("doc_id"), "n_features", "weight", "score", F.col("rank").cast("long").alias("rank")]
    return placed.select(*cols).unionByName(rest.select(*cols))


def _oracle() -> str:
    words = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    runs = " || ".join(f"list_transform(range(len(w) - {k}), lambda i: array_to_string(w[i + 1 : i + {k + 1}], ' '))" for k in range(ORDERS))
    return f"""
WITH {CRC_TABLE},
d AS (SELECT row_number() OVER () AS r, doc_id, {words} AS w FROM documents),
b AS (SELECT {words} AS w FROM benchmark),
df AS (SELECT r, unnest({runs}) AS g FROM d),
bf AS (SELECT unnest({runs}) AS g FROM b),
dg AS (SELECT r, g, count(*) AS c FROM df GROUP BY r, g),
names AS (SELECT DISTINCT g FROM (SELECT g FROM dg UNION ALL SELECT g FROM bf)),
coded AS (SELECT g, {crc32_sql("g")} % {BUCKETS} AS k FROM names, crc_table),
s AS (SELECT k, sum(c) AS s FROM dg JOIN coded USING (g) GROUP BY k),
t AS (SELECT k, count(*) AS t FROM bf JOIN coded USING (g) GROUP BY k),
gain AS (
  SELECT k, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * (coalesce((SELECT sum(s) FROM s), 0) + {BUCKETS})::DOUBLE
           / ((coalesce(s, 0) + 1)::DOUBLE * (coalesce((SELECT sum(t) FROM t), 0) + {BUCKETS})::DOUBLE))) AS gain
  FROM (SELECT range AS k FROM range({BUCKETS})) LEFT JOIN s USING (k) LEFT JOIN t USING (k)),
sums AS (SELECT r, CAST(sum(c) AS BIGINT) AS n_features, CAST(sum(c * gain) AS BIGINT) AS weight FROM dg JOIN coded USING (g) JOIN gain USING (k) GROUP BY r),
scored AS (
  SELECT doc_id, len(w) AS n_words, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
         coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM d LEFT JOIN sums USING (r)),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_words >= {MIN_WORDS} ORDER BY score DESC, doc_id, n_features) AS place FROM scored)
SELECT doc_id, n_features, weight, score,
       CASE WHEN n_words >= {MIN_WORDS} AND place <= (SELECT count(*) FROM scored WHERE n_words >= {MIN_WORDS}) * {DRAWN_PERCENT} // 100 THEN place END AS rank
FROM placed"""


ORACLE = _oracle()
