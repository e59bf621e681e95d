"""Live cell statistics with Structured Streaming.

Runs arrive as files.  Two streams share one folder ``table``:

1. :func:`receive` routes arrivals.  A run that lies the delay or more behind the newest run of
   all earlier batches is *late*; each batch is written once, as ``arrivals/batch=<n>/late=<bool>``.
2. :func:`aggregate` reads the on-time runs: watermark, ``dropDuplicatesWithinWatermark`` on
   the run id, unpivot, built-in aggregates in ``update`` mode.  Its dedupe state expires with
   the watermark, so it holds the runs of one delay and not the history; a copy that comes
   after its state expired is late by definition and takes the other way.

Late runs are counted (:func:`late_counts`) and merged by a batch job
(:func:`merged_cells`): copies go, runs already counted go (only the on-time runs of the late
runs' time range are read), and the cells' count, mean and spread are combined exactly.

Updated cells are published as ``cells/part=<batch>``; every ``COMPACT`` parts they are folded
into one ``cells/full=<batch>`` and the older folders removed.  Readers take the newest full
folder and the parts behind it, so a read never opens more than ``COMPACT`` parts; a folder
counts once its success marker is there, so a kill leaves the last finished state, and a batch
that runs again replaces its own folder.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import storage
from runlens.operators.cells import last_wins
from runlens.operators.runs import metric_rows, null_safe_join

RUN_SCHEMA = T.StructType([
    T.StructField("run_id", T.LongType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_id", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("tps", T.DoubleType()),
    T.StructField("elapsed", T.DoubleType()),
])

KEYS = ["model", "prompt_id", "metric"]
STATS = ["n", "mean", "variance", "stdev"]
DELAY, COMPACT = "7 days", 8


def live_cells(stream: DataFrame, watermark: str | None = DELAY, id_col: str = "run_id",
               ts_col: str = "started_at") -> DataFrame:
    """[ST1] The streaming aggregation (no sink).

    The watermark bounds the dedupe state; the stream must not hold runs behind it
    (:func:`receive` routes those away).  ``None``: every run counts once, however late it
    arrives, and the state keeps one key per run id for ever."""
    if watermark is None:
        dedup = stream.dropDuplicates([id_col])
    else:
        dedup = stream.withWatermark(ts_col, watermark).dropDuplicatesWithinWatermark([id_col])
    return _stats(metric_rows(dedup, ["model", "prompt_id", id_col, ts_col]))


def _stats(rows: DataFrame) -> DataFrame:
    v = F.col("value")
    return rows.groupBy(*KEYS).agg(
        F.count(F.lit(1)).alias("n"), F.avg(v).alias("mean"),
        F.coalesce(F.var_samp(v), F.lit(0.0)).alias("variance"),
        F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias("stdev"))


def receive(spark: SparkSession, source_dir: str, table: str, checkpoint: str, delay: str = DELAY,
            files_per_trigger: int = 64) -> None:
    """Route every new file's runs to on-time and late arrivals (``availableNow``)."""
    arrivals = f"{table}/arrivals"
    stream = spark.readStream.schema(RUN_SCHEMA).option("maxFilesPerTrigger", files_per_trigger) \
        .option("recursiveFileLookup", "true").parquet(source_dir)

    def route(batch: DataFrame, batch_id: int) -> None:
        earlier = [n for n in storage.numbered(spark, f"{table}/newest", "batch") if n < batch_id]
        newest = None
        if earlier:
            newest = spark.read.parquet(f"{table}/newest/batch={earlier[-1]}").first()["newest"]
        edge = F.lit(newest).cast("timestamp") - F.expr(f"INTERVAL {delay}")
        # a run on the edge is late too: the watermark drops what is not behind but on it
        late = F.coalesce(F.col("started_at") <= edge, F.lit(False))
        out = f"{arrivals}/batch={batch_id}"
        batch.withColumn("late", late).write.mode("overwrite").partitionBy("late").parquet(out)
        seen = spark.read.schema(RUN_SCHEMA).option("recursiveFileLookup", "true").parquet(out)
        seen.agg(F.greatest(F.max("started_at"), F.lit(newest).cast("timestamp")).alias("newest")).coalesce(1) \
            .write.mode("overwrite").parquet(f"{table}/newest/batch={batch_id}")
        for n in earlier[:-1]:
            storage.remove(spark, f"{table}/newest/batch={n}")

    q = stream.writeStream.foreachBatch(route).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    q.awaitTermination()


def aggregate(spark: SparkSession, table: str, checkpoint: str, delay: str = DELAY, compact: int = COMPACT) -> list[dict]:
    """Fold the on-time arrivals into the published cells; returns the stream's progress
    records.  All arrivals that are there are one batch, so the watermark never runs ahead
    of a batch that :func:`receive` judged as a whole."""
    def publish(batch: DataFrame, batch_id: int) -> None:
        publish_cells(spark, batch, f"{table}/cells", batch_id, compact)

    path = f"{table}/arrivals/batch=*/late=false"
    stream = spark.readStream.schema(RUN_SCHEMA).parquet(path)
    q = (live_cells(stream, delay).writeStream.outputMode("update").foreachBatch(publish)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return list(q.recentProgress)


def publish_cells(spark: SparkSession, cells: DataFrame, path: str, batch_id: int, compact: int = COMPACT) -> None:
    """[SNK9] Publish a batch's updated cells; fold the parts together now and then."""
    cells.write.mode("overwrite").parquet(f"{path}/part={batch_id}")
    parts = storage.numbered(spark, path, "part")
    if len(parts) < compact:
        return
    read_cells(spark, path).coalesce(1).write.mode("overwrite").parquet(f"{path}/full={batch_id}")
    for n in storage.numbered(spark, path, "full"):
        if n < batch_id:
            storage.remove(spark, f"{path}/full={n}")
    for n in parts:
        storage.remove(spark, f"{path}/part={n}")


def open_folders(spark: SparkSession, path: str) -> list[tuple[int, str]]:
    """Number and name of the folders a read opens: the newest full one, parts behind it."""
    full = storage.numbered(spark, path, "full")[-1:]
    parts = [n for n in storage.numbered(spark, path, "part") if not full or n > full[0]]
    return [(n, f"{path}/full={n}") for n in full] + [(n, f"{path}/part={n}") for n in parts]


def read_cells(spark: SparkSession, path: str, keys: Sequence[str] = KEYS) -> DataFrame:
    """Latest state of every published cell."""
    out = None
    for n, folder in open_folders(spark, path):  # at most ``COMPACT`` + 1 folders
        df = spark.read.parquet(folder).select(*keys, *STATS, F.lit(n).alias("version"))
        out = df if out is None else out.unionByName(df)
    if out is None:
        kinds = "model string, prompt_id string, metric string, n long, mean double, variance double, stdev double"
        return spark.createDataFrame([], kinds)
    return last_wins(out, keys, STATS, "version")


def _arrivals(spark: SparkSession, table: str, late: bool) -> DataFrame:
    df = spark.read.schema(T.StructType([*RUN_SCHEMA.fields, T.StructField("batch", T.LongType()), T.StructField("late", T.BooleanType())]))
    if not storage.exists(spark, f"{table}/arrivals"):
        return spark.createDataFrame([], RUN_SCHEMA)
    return df.parquet(f"{table}/arrivals").filter(F.col("late") == late).drop("batch", "late")


def late_counts(spark: SparkSession, table: str) -> DataFrame:
    """Per model: late arrivals and the distinct runs among them."""
    late = _arrivals(spark, table, True)
    return late.groupBy("model").agg(F.count(F.lit(1)).alias("n_late"), F.count_distinct("run_id").alias("n_late_runs"))


def late_runs(spark: SparkSession, table: str) -> DataFrame:
    """Late runs that were never counted: one row a run, none that was on time as well.

    On-time arrivals are read for the late runs' time range only; ids are compared, so rows
    of a few bytes are shuffled."""
    late = _arrivals(spark, table, True).dropDuplicates(["run_id"])
    span = late.agg(F.min("started_at").alias("lo"), F.max("started_at").alias("hi")).first()
    if span["lo"] is None:
        return late
    on_time = _arrivals(spark, table, False).filter(F.col("started_at").between(F.lit(span["lo"]), F.lit(span["hi"]))).select("run_id")
    return late.join(on_time, "run_id", "left_anti")


def combine(a: DataFrame, b: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """Statistics of the union of two disjoint sets of runs, from the statistics of each
    (Chan, Golub and LeVeque's update)."""
    left = a.select(*keys, F.struct(*STATS).alias("a"))
    right = b.select(*keys, F.struct(*STATS).alias("b"))
    j = null_safe_join(left, right, keys, "left").unionByName(
        null_safe_join(right, left.drop("a"), keys, "left_anti").withColumn("a", F.lit(None).cast(left.schema["a"].dataType)))

    def part(side: str, name: str) -> F.Column:
        return F.coalesce(F.col(f"{side}.{name}").cast("double"), F.lit(0.0))

    na, nb = part("a", "n"), part("b", "n")
    n, gap = na + nb, part("b", "mean") - part("a", "mean")
    mean = F.when(nb == 0, part("a", "mean")).when(na == 0, part("b", "mean")).otherwise(part("a", "mean") + gap * nb / n)
    spread = part("a", "variance") * F.greatest(na - 1, F.lit(0.0)) + part("b", "variance") * F.greatest(nb - 1, F.lit(0.0))
    spread = spread + F.when((na > 0) & (nb > 0), gap * gap * na * nb / n).otherwise(F.lit(0.0))
    variance = F.when(n > 1, spread / (n - 1)).otherwise(F.lit(0.0))
    return j.select(*keys, n.cast("long").alias("n"), mean.alias("mean"), variance.alias("variance"), F.sqrt(variance).alias("stdev"))


def published_cells(spark: SparkSession, table: str) -> DataFrame:
    """The cells as the stream has published them, without late runs."""
    return read_cells(spark, f"{table}/cells")


def merged_cells(spark: SparkSession, table: str) -> DataFrame:
    """[ST1] Published cells and late runs together: what a batch job over all runs gives."""
    late = _stats(metric_rows(late_runs(spark, table), ["model", "prompt_id", "run_id", "started_at"]))
    return combine(published_cells(spark, table), late)


def run_live_cells(spark: SparkSession, source_dir: str, table: str, checkpoint: str,
                   files_per_trigger: int = 64, delay: str = DELAY, compact: int = COMPACT) -> list[dict]:
    """[ST1, SNK9] Receive and aggregate every file present in ``source_dir``; call it again
    for new files.  Returns the aggregating stream's progress records."""
    receive(spark, source_dir, table, f"{checkpoint}/receive", delay, files_per_trigger)
    return aggregate(spark, table, f"{checkpoint}/aggregate", delay, compact)
