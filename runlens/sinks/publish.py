"""Publishing finished cells one after another into a shared table of runs.

Layout: ``<path>/runs/run_set=../model=../prompt_id=../`` holds the rows of a cell, and
``<path>/commits`` one record per published cell.  A publish overwrites the partitions of its
own cells only (dynamic partition overwrite), marks its rows with an attempt id, and then
appends the commit records.  Readers show a cell's rows only if their attempt is the cell's
latest commit, so a job killed between cells, or between data and commit, shows finished
cells and nothing else; running it again replaces what was left.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens import storage
from runlens.operators.cells import last_wins
from runlens.operators.runs import null_safe_join

CELL = ("run_set", "model", "prompt_id")
#: Files a cell is written to at most, so that a large one is no single task's.
FILES = 8


def publish(runs: DataFrame, path: str, run_set: str, cell: Sequence[str] = CELL, files: int = FILES) -> str:
    """[SNK9] Publish the cells of ``runs`` (model, prompt_id, ...) under ``run_set``; returns
    the attempt id."""
    attempt = uuid.uuid4().hex
    rows = runs.withColumn("run_set", F.lit(run_set)).withColumn("attempt", F.lit(attempt))
    others = [F.col(c) for c in rows.columns if c not in cell]
    dealt = rows.repartition(*cell, F.pmod(F.xxhash64(*others), F.lit(files)))
    dealt.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*cell).parquet(f"{path}/runs")
    written = runs.sparkSession.read.parquet(f"{path}/runs").filter((F.col("run_set") == run_set) & (F.col("attempt") == attempt))
    records = written.groupBy(*cell).agg(F.count(F.lit(1)).alias("n_rows"))
    records = records.withColumn("attempt", F.lit(attempt)).withColumn("committed_at", F.current_timestamp())
    records.coalesce(1).write.mode("append").parquet(f"{path}/commits")
    return attempt


def commits(spark: SparkSession, path: str, cell: Sequence[str] = CELL) -> DataFrame:
    """The latest commit of every cell."""
    if not storage.exists(spark, f"{path}/commits"):
        return spark.createDataFrame([], ", ".join(f"{c} string" for c in cell) + ", attempt string, n_rows long, committed_at timestamp")
    return last_wins(spark.read.parquet(f"{path}/commits"), cell, ["attempt", "n_rows", "committed_at"], "committed_at")


def read_runs(spark: SparkSession, path: str, run_sets: Sequence[str] | None = None, cell: Sequence[str] = CELL) -> DataFrame:
    """[SO3] Rows of the finished cells of the given run sets (all: ``None``), appended: one
    scan with partition pruning, checked against the commits."""
    rows, done = spark.read.parquet(f"{path}/runs"), commits(spark, path, cell).select(*cell, F.col("attempt").alias("_attempt"))
    if run_sets is not None:
        rows, done = (df.filter(F.col("run_set").isin(*run_sets)) for df in (rows, done))
    return null_safe_join(rows, done, list(cell)).filter(F.col("attempt") == F.col("_attempt")).drop("attempt", "_attempt")
