"""Catalogue queries over sources, sinks and the stream: data derived from the
driver tables is written under the session's shared scratch folder
(``spark.checkpoint.dir``), read back with the library readers and compared with
the SQL of the source cells."""

from __future__ import annotations

from pyspark.sql import SparkSession, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import text as tx
from runlens.operators import cells as C
from runlens.operators import runs as R
from runlens.plans import adapters as A
from runlens.plans import q_runs as QR
from runlens.plans.registry import register
from runlens.session import scratch_path
from runlens.sinks import publish as PB
from runlens.sinks import reports as SK
from runlens.sources import reports as SR
from runlens.streaming import live_cells as LC


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


HOST = "node-1"
GPU = "GPU0 (12288 MB VRAM), GPU1 (8192 MB VRAM)"


# --- csv_roundtrip: SNK1, SRC1, SRC2 (a run set per model, cells in measurement order) ---
@register("csv_roundtrip", _w(A.METRICS_SQL, QR.RANKED_SQL, """firsts AS (
  SELECT model, prompt_id, metric, list(value ORDER BY run_no) AS vals, min(started_at) AS at, arg_min(event_id, run_no) AS ev
  FROM ranked WHERE run_no <= 5 GROUP BY model, prompt_id, metric)""") + f"""
SELECT c.model, c.prompt_id, c.metric, c.mean, c.stdev,
  array_to_string(list_transform(list_concat(f.vals, [CAST(0 AS DOUBLE), 0, 0, 0, 0])[1:5],
                                 lambda x: printf('%.4f', x)), ',') AS runs_text,
  '{HOST}' AS host, '{GPU.split(",")[0]}' AS gpu,
  strftime(min(f.at) OVER (PARTITION BY c.model), '%Y-%m-%d %H:%M:%S') AS timestamp,
  CAST(row_number() OVER (PARTITION BY c.model ORDER BY f.at, f.ev, c.metric DESC) AS INTEGER) AS row_no
FROM cells c JOIN firsts f ON c.model = f.model AND c.prompt_id = f.prompt_id AND c.metric = f.metric""")
def q_csv_roundtrip(spark, sf):
    mr = QR.metric_runs(spark, sf)
    begun = F.min(F.struct("started_at", "event_id")).alias("begun")
    cells = R.null_safe_join(C.cell_stats(mr, QR.KEYS, extra=[begun]), C.padded_runs(mr, QR.KEYS, QR.ORDER), QR.KEYS)
    run_set = Window.partitionBy("run_set")  # the cells of one report
    cells = (cells.withColumn("run_set", F.col("model"))
             .withColumn("row_ord", F.row_number().over(run_set.orderBy("begun", F.desc("metric"))))
             .withColumn("timestamp", F.date_format(F.min("begun.started_at").over(run_set), "yyyy-MM-dd HH:mm:ss"))
             .select("run_set", "row_ord", "model", F.lit(schemas.UNKNOWN_SIZE).alias("size"), "prompt_id",
                     F.col("prompt_id").alias("prompt_name"), "metric", "runs", "mean", "variance", "stdev",
                     F.lit(HOST).alias("host"), F.lit(GPU).alias("gpu"), "timestamp"))
    path = scratch_path(spark, "cells-csv")
    SK.write_cell_csv(cells, path)
    t = SR.typed_cells(SR.read_reports(spark, f"{path}/run_set=*/part-*"))
    nth = F.row_number().over(Window.partitionBy("file").orderBy("row_ord"))
    return t.select("model", "prompt_id", "metric", "mean", "stdev",
                    F.array_join(F.transform("runs", lambda x: tx.fmt(x, 4)), ",").alias("runs_text"),
                    "meta.host", "meta.gpu", "meta.timestamp", nth.alias("row_no"))


# --- jsonl_roundtrip: SRC3, SRC4, SRC5 -------------------------------------------------
@register("jsonl_roundtrip", _w(A.samples_sql()) + """
SELECT model || ':q4' AS model, doc_id, task_id, pass_at_1, md5(reply) AS leaf_md5 FROM samples""")
def q_jsonl_roundtrip(spark, sf):
    s = A.samples(spark, sf)
    doc = F.struct("task_id", F.col("stub").alias("prompt"), F.col("hidden_test").alias("test"), "entry_point")
    out = s.select(F.concat("model", F.lit(":q4")).alias("model"), "doc_id", doc.alias("doc"), "resps",
                   "filtered_resps", F.col("pass_at_1").alias("pass@1"))
    path = scratch_path(spark, "samples-jsonl")
    SK.write_samples(out, path)
    r = SR.read_samples(spark, f"{path}/*/*.json", hive_dirs=True)
    return r.select("model", "doc_id", F.col("doc.task_id").alias("task_id"), F.col("`pass@1`").alias("pass_at_1"),
                    F.md5(tx.first_leaf("resps", "filtered_first", filtered_is_leaf=True)).alias("leaf_md5"))


# --- token_json_explode: SRC7 ----------------------------------------------------------
@register("token_json_explode", _w(A.RUNS_SQL, """r AS (
  SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY started_at, event_id) AS rn FROM runs),
stops AS (SELECT model, prompt_id, min(rn) AS stop FROM r WHERE error GROUP BY model, prompt_id),
ok AS (SELECT r.* FROM r LEFT JOIN stops s ON r.model = s.model AND r.prompt_id = s.prompt_id
       WHERE s.stop IS NULL OR r.rn < s.stop)""") + """
SELECT model, prompt_id, round(avg(eval_count), 4) AS gen_tokens_mean,
  array_to_string(list_transform(list(eval_count ORDER BY rn), lambda x: CAST(x AS VARCHAR)), ',') AS gen_tokens_runs,
  arg_min(user_id, rn) AS prompt_tokens,
  round(avg(event_id % 300), 4) AS thinking_chars_mean,
  round(avg(total_duration / 1e9), 4) AS wall_s_mean
FROM ok GROUP BY model, prompt_id""")
def q_token_json(spark, sf):
    r = A.runs(spark, sf).select(
        "model", "prompt_id", "started_at", "event_id", "error",
        F.col("eval_count").alias("gen_tokens"), F.col("user_id").alias("prompt_tokens"),
        (F.col("event_id") % 300).alias("thinking_chars"), (F.col("total_duration") / F.lit(1e9)).alias("wall_s"))
    t = C.token_cells(r, ["model", "prompt_id"], QR.ORDER, F.col("error"))
    path = scratch_path(spark, "token-json")
    SK.write_keyed_json(t, path, value_cols=[f.name for f in schemas.TOKEN_CELL.fields], per_file="model")
    back = SR.read_keyed_json(spark, f"{path}/part_of=*/part-*")
    return back.select(
        "model", "prompt_id", F.round("gen_tokens_mean", 4).alias("gen_tokens_mean"),
        F.array_join(F.transform("gen_tokens_runs", lambda x: x.cast("string")), ",").alias("gen_tokens_runs"),
        "prompt_tokens", F.round("thinking_chars_mean", 4).alias("thinking_chars_mean"),
        F.round("wall_s_mean", 4).alias("wall_s_mean"))


# --- score_file_explode: SRC8 ----------------------------------------------------------
@register("score_file_explode", _w(A.OUTCOMES_SQL) + """
SELECT model, 'code' AS task, 'pass@1' AS metric, round(avg(CAST(passed AS DOUBLE)), 4) AS value
FROM outcomes GROUP BY model
UNION ALL
SELECT model, 'safety' AS task, 'flag_rate' AS metric, round(avg(CAST(NOT passed AS DOUBLE)), 4) AS value
FROM outcomes GROUP BY model""")
def q_score_files(spark, sf):
    o = A.outcomes(spark, sf)
    g = o.groupBy("model").agg(F.avg(F.col("passed").cast("double")).alias("p"),
                               F.avg((~F.col("passed")).cast("double")).alias("f"))
    results = F.create_map(F.lit("code"), F.create_map(F.lit("pass@1"), F.col("p")),
                           F.lit("safety"), F.create_map(F.lit("flag_rate"), F.col("f")))
    config = F.struct(F.col("model"), F.lit("quant=q4").alias("model_args"))
    path = scratch_path(spark, "score-files")
    SK.write_score_files(g.select(results.alias("results"), config.alias("config")), path, per_file="config.model")
    back = SR.read_score_files(spark, f"{path}/part_of=*/part-*")
    return back.select("model", "task", "metric", F.round("value", 4).alias("value"))


# --- response_parse: SRC6, SC11, SC12 --------------------------------------------------
@register("response_parse", """
WITH e AS (SELECT event_id, event_id % 997 AS eval_count,
  CAST(round(value * 100) AS BIGINT) * 10000000 AS eval_ns,
  CAST(round(value * 100) AS BIGINT) * 10000000 + user_id * 1000000 AS total_ns, props FROM events)
SELECT event_id, eval_count,
  round(CASE WHEN eval_ns > 0 THEN eval_count / (eval_ns / 1e9) ELSE 0 END, 4) AS tps,
  round(CASE WHEN total_ns > 0 THEN total_ns / 1e9 ELSE 0 END, 4) AS elapsed,
  CAST(CASE WHEN event_id % 4 = 0 THEN 0 ELSE length(props) END AS INTEGER) AS content_chars,
  0 AS thinking_chars
FROM e""")
def q_response_parse(spark, sf):
    r = A.runs_with_props(spark, sf)
    msg = F.struct(F.lit("assistant").alias("role"),
                   F.when(F.col("event_id") % 4 == 0, F.lit(None).cast("string")).otherwise(F.col("props")).alias("content"),
                   F.lit(None).cast("string").alias("thinking"))
    inner = F.struct("eval_count", F.col("user_id").alias("prompt_eval_count"), "eval_duration", "total_duration",
                     msg.alias("message"))
    layout = F.col("event_id") % 3
    js = (F.when(layout == 0, F.to_json(inner))
          .when(layout == 1, F.to_json(F.struct(inner.alias("response"))))
          .otherwise(F.to_json(F.struct(inner.alias("model_dump")))))
    recs = r.select("event_id", js.alias("json"))
    p = SR.parse_responses(recs, "json")
    return p.select("event_id", "eval_count",
                    F.round(R.tokens_per_sec("eval_count", "eval_duration"), 4).alias("tps"),
                    F.round(R.elapsed_sec("total_duration"), 4).alias("elapsed"),
                    F.coalesce(F.length("message.content"), F.lit(0)).alias("content_chars"),
                    F.coalesce(F.length("message.thinking"), F.lit(0)).alias("thinking_chars"))


# --- stream_cells: ST1 (same oracle as cell_stats) -------------------------------------
WEEKS = 5


def _stream_source(spark: SparkSession, sf: str, src: str) -> None:
    """Runs as files by week (some runs weeks after their time), and once more a tenth of the
    last week's: one scan and one partitioned write."""
    m = QR.measured(spark, sf).select(
        F.col("event_id").alias("run_id"), "model", "prompt_id",
        F.col("started_at").cast("timestamp").alias("started_at"), "tps", "elapsed")
    week = F.floor((F.unix_seconds("started_at") - F.unix_seconds(F.lit("2024-01-01 00:00:00").cast("timestamp")))
                   / F.lit(7 * 86400))
    last = F.lit(WEEKS - 1).cast("bigint")
    week = F.when(F.col("run_id") % 13 == 0, last).otherwise(F.least(week, last))
    again = F.when((week == last) & (F.col("run_id") % 10 == 0), last + 1)
    m.withColumn("week", F.explode(F.array_compact(F.array(week, again)))).write.partitionBy("week").parquet(src)


def _streamed(spark: SparkSession, sf: str) -> str:
    src, table, ckpt = (scratch_path(spark, n) for n in ("stream-src", "stream-table", "stream-ckpt"))
    _stream_source(spark, sf, src)
    LC.run_live_cells(spark, src, table, ckpt, files_per_trigger=8)
    return table


@register("stream_cells", _w(A.METRICS_SQL) + "SELECT * FROM cells")
def q_stream_cells(spark, sf):
    c = LC.merged_cells(spark, _streamed(spark, sf))
    return c.select(*LC.KEYS, "n", *[F.round(F.round(x, 9), 4).alias(x) for x in ("mean", "variance", "stdev")])


# --- append_runs: SO3, SNK9 (two published run sets, one of them twice) -----------------
@register("append_runs", _w(A.METRICS_SQL) + "SELECT * FROM cells")
def q_append_runs(spark, sf):
    rows = QR.metric_runs(spark, sf)
    second = F.col("started_at") >= F.lit(QR.RERUN_FROM).cast("timestamp_ntz")
    path = scratch_path(spark, "published-runs")
    PB.publish(rows.filter(second).withColumn("value", F.lit(0.0)), path, "second half")  # a run that is run again
    PB.publish(rows.filter(~second), path, "first half")
    PB.publish(rows.filter(second), path, "second half")
    return C.cell_stats(PB.read_runs(spark, path, ["first half", "second half"]), QR.KEYS)
