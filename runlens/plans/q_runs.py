"""Catalogue queries over inference runs (adapter A1) and large cells (A4)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import text as tx
from runlens.operators import cells as C
from runlens.operators import matrix as M
from runlens.operators import runs as R
from runlens.plans import adapters as A
from runlens.plans.registry import register

KEYS = ["model", "prompt_id", "metric"]
ORDER = ["started_at", "event_id"]
PAT = schemas.PROMPT_ID_PATTERN


def measured(spark: SparkSession, sf: str) -> DataFrame:
    """A1 with tps / elapsed, one row per attempt."""
    return R.response_metrics(A.runs(spark, sf))


def metric_runs(spark: SparkSession, sf: str) -> DataFrame:
    return R.metric_rows(measured(spark, sf), ["model", "prompt_id", "event_id", "started_at"])


def cells(spark: SparkSession, sf: str) -> DataFrame:
    return C.cell_stats(metric_runs(spark, sf), KEYS)


def tps_cells(spark: SparkSession, sf: str) -> DataFrame:
    c = cells(spark, sf)
    return c.filter((F.col("metric") == schemas.TPS) & M.is_prompt_id("prompt_id"))


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


RANKED_SQL = """ranked AS (
  SELECT *, row_number() OVER (PARTITION BY model, prompt_id, metric ORDER BY started_at, event_id) AS run_no
  FROM metric_rows)"""
TPS_CELLS_SQL = """tps_cells AS (
  SELECT * FROM cells WHERE metric = 'Tokens_Per_Sec' AND regexp_matches(prompt_id, '^P[0-9]+(_T[0-9]+)?$'))"""


# --- cell_stats (flagship): PF1, PF2, PF3, PV6, AG1 -------------------------------
@register("cell_stats", _w(A.METRICS_SQL) + "SELECT * FROM cells")
def q_cell_stats(spark, sf):
    return cells(spark, sf)


# --- cell_runs_padded: AG2, WN5, SR5 ---------------------------------------------
@register("cell_runs_padded", _w(A.METRICS_SQL, RANKED_SQL, """firsts AS (
  SELECT model, prompt_id, metric, list(value ORDER BY run_no) AS vals FROM ranked WHERE run_no <= 5
  GROUP BY model, prompt_id, metric)""") + """
SELECT c.model, c.prompt_id, c.metric, c.n, c.mean,
  array_to_string(list_transform(list_concat(f.vals, [CAST(0 AS DOUBLE), 0, 0, 0, 0])[1:5],
                                 lambda x: printf('%.4f', x)), ',') AS runs_text
FROM cells c JOIN firsts f ON c.model = f.model AND c.prompt_id = f.prompt_id AND c.metric = f.metric""")
def q_cell_runs_padded(spark, sf):
    mr = metric_runs(spark, sf)
    padded = C.padded_runs(mr, KEYS, ORDER)
    text = F.array_join(F.transform("runs", lambda x: tx.fmt(x, 4)), ",")
    return (R.null_safe_join(C.cell_stats(mr, KEYS), padded, KEYS)
            .select(*KEYS, "n", "mean", text.alias("runs_text")))


# --- run_ordinals: WN5 for every run (ordinals of cells of any size) --------------------
@register("run_ordinals", _w(A.RUNS_SQL) + """
SELECT event_id, model, prompt_id,
  row_number() OVER (PARTITION BY model, prompt_id ORDER BY started_at, event_id) AS run_no
FROM runs""")
def q_run_ordinals(spark, sf):
    r = A.runs(spark, sf).select("event_id", "model", "prompt_id", "started_at")
    o = C.ranked(r, ["model", "prompt_id"], ORDER, "rank")
    return o.select("event_id", "model", "prompt_id", (F.col("rank") + 1).alias("run_no"))


# --- grand_mean_by_model: AG3 ----------------------------------------------------
@register("grand_mean_by_model", _w(A.METRICS_SQL, TPS_CELLS_SQL) + """
SELECT model, count(mean) AS n_prompts, round(avg(mean), 4) AS grand_mean,
  round(stddev_samp(mean), 4) AS cross_prompt_sd
FROM tps_cells GROUP BY model""")
def q_grand_mean(spark, sf):
    g = C.grand_mean(tps_cells(spark, sf), ["model"])
    return g.select("model", "n_prompts", F.round("grand_mean", 4).alias("grand_mean"),
                    F.round("cross_prompt_sd", 4).alias("cross_prompt_sd"))


# --- cov_matrix_long: PV4, PF6, PF7, SNK4 ----------------------------------------
@register("cov_matrix_long", _w(A.METRICS_SQL, TPS_CELLS_SQL, """cv AS (
  SELECT model, prompt_id, mean, stdev,
    CASE WHEN mean <> 0 THEN stdev / mean WHEN stdev = 0 THEN CAST('nan' AS DOUBLE)
         ELSE CAST('inf' AS DOUBLE) END AS cov
  FROM tps_cells)""") + """
SELECT model, prompt_id, mean, stdev, round(cov, 4) AS cov,
  printf('%.1f', mean) AS tps_text, printf('%.3f', cov) AS cov_text
FROM cv""")
def q_cov_matrix_long(spark, sf):
    c = tps_cells(spark, sf).withColumn("cov", M.coefficient_of_variation("stdev", "mean"))
    return c.select("model", "prompt_id", "mean", "stdev", F.round("cov", 4).alias("cov"),
                    tx.fmt("mean", 1).alias("tps_text"), tx.fmt("cov", 3).alias("cov_text"))


def _pivot_sql(source: str, value: str = "mean") -> str:
    cols = ",\n  ".join(f"max(CASE WHEN prompt_id = '{p}' THEN {value} END) AS \"{p}\""
                        for p in schemas.CANONICAL_PROMPTS)
    return f"SELECT model,\n  {cols}\nFROM {source} GROUP BY model"


# --- pivot_mean_strict: PV1, PV3 -------------------------------------------------
@register("pivot_mean_strict", _w(A.METRICS_SQL, TPS_CELLS_SQL) + _pivot_sql("tps_cells"))
def q_pivot_strict(spark, sf):
    c = tps_cells(spark, sf)
    return M.pivot_cells(c, "model", "prompt_id", "mean", M.ordered_prompts(c), on_duplicate="error")


# --- pivot_mean_last: PV2, AG15, WN2 ---------------------------------------------
# two cell sets: all runs (set 1) and a later re-run -- the runs of the second half
# of the month, without P3 -- (set 2, later, so it wins where present).
RERUN_FROM = "2024-01-16 00:00:00"
_ODD_SQL = A.metrics_sql("_odd", f"ts >= TIMESTAMP '{RERUN_FROM}'")


@register("pivot_mean_last", _w(A.METRICS_SQL, _ODD_SQL, """bothsets AS (
  SELECT model, prompt_id, mean, 1 AS set_ord FROM cells WHERE metric = 'Tokens_Per_Sec'
  UNION ALL
  SELECT model, prompt_id, mean, 2 AS set_ord FROM cells_odd WHERE metric = 'Tokens_Per_Sec' AND prompt_id <> 'P3'),
lastwins AS (SELECT model, prompt_id, arg_max(mean, set_ord) AS mean FROM bothsets GROUP BY model, prompt_id)""")
    + _pivot_sql("lastwins"))
def q_pivot_last(spark, sf):
    all_cells = tps_cells(spark, sf).select("model", "prompt_id", "mean", F.lit(1).alias("set_ord"))
    rerun = A.runs(spark, sf).filter(F.col("started_at") >= F.lit(RERUN_FROM).cast("timestamp_ntz"))
    odd = R.metric_rows(R.response_metrics(rerun),
                        ["model", "prompt_id", "event_id", "started_at"])
    odd_cells = (C.cell_stats(odd, KEYS)
                 .filter((F.col("metric") == schemas.TPS) & (F.col("prompt_id") != "P3"))
                 .select("model", "prompt_id", "mean", F.lit(2).alias("set_ord")))
    return M.pivot_cells(all_cells.unionByName(odd_cells), "model", "prompt_id", "mean",
                         schemas.CANONICAL_PROMPTS, on_duplicate="last", order_col="set_ord")


# --- metric_pair_cells: JN4, PF9 -------------------------------------------------
@register("metric_pair_cells", _w(A.METRICS_SQL) + """
SELECT model, prompt_id,
  max(CASE WHEN metric = 'Tokens_Per_Sec' THEN mean END) AS tps_mean,
  max(CASE WHEN metric = 'Tokens_Per_Sec' THEN stdev END) AS tps_sd,
  max(CASE WHEN metric <> 'Tokens_Per_Sec' THEN mean END) AS elap_mean,
  max(CASE WHEN metric <> 'Tokens_Per_Sec' THEN stdev END) AS elap_sd
FROM cells GROUP BY model, prompt_id""")
def q_metric_pair(spark, sf):
    return C.metric_pair(cells(spark, sf), ["model", "prompt_id"])


# --- first_seen_models: WN1, AG14 ------------------------------------------------
@register("first_seen_models", _w(A.RUNS_SQL) + """
SELECT model, min(event_id) AS first_ord, count(*) AS n_rows, count(DISTINCT prompt_id) AS n_prompts,
  CAST(row_number() OVER (ORDER BY min(event_id), model) AS INTEGER) AS seen_rank
FROM runs GROUP BY model""")
def q_first_seen(spark, sf):
    fs = C.first_seen(A.runs(spark, sf), "model", "event_id", distinct_of=["prompt_id"])
    return fs.select("model", "first_ord", "n_rows", F.col("n_prompt_ids").alias("n_prompts"),
                     F.col("seen_rank").cast("int").alias("seen_rank"))


# --- data_profile: AG14 (distinct profile of a run table) ------------------------------
@register("data_profile", _w(A.RUNS_SQL, """m AS (SELECT model, min(event_id) AS first_ord FROM runs GROUP BY model),
p AS (SELECT DISTINCT prompt_id FROM runs)""") + """
SELECT (SELECT count(*) FROM m) AS n_models,
  (SELECT string_agg(model, ',' ORDER BY first_ord, model) FROM m) AS models_in_order,
  (SELECT string_agg(prompt_id, ',' ORDER BY prompt_id) FROM p) AS prompt_ids,
  (SELECT count(*) FROM runs) AS n_rows""")
def q_data_profile(spark, sf):
    # one global aggregate over the (model, prompt) groups -- a bounded table -- so
    # no join is needed; array_distinct keeps the first occurrence, i.e. the
    # first-seen model order of the list sorted by first position
    g = A.runs(spark, sf).groupBy("model", "prompt_id").agg(
        F.min("event_id").alias("first_ord"), F.count(F.lit(1)).alias("n"))
    in_order = F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("first_ord", "model"))),
                                            lambda x: x["model"]))
    prof = g.agg(in_order.alias("_m"), F.array_sort(F.collect_set("prompt_id")).alias("_p"), F.sum("n").alias("n_rows"))
    return prof.select(F.size("_m").cast("bigint").alias("n_models"), F.array_join("_m", ",").alias("models_in_order"),
                       F.array_join("_p", ",").alias("prompt_ids"), "n_rows")


# --- robust_limits: AG17 ---------------------------------------------------------
@register("robust_limits", _w(A.METRICS_SQL) + """
SELECT metric, round(quantile_cont(mean, 0.02), 4) AS vmin, round(quantile_cont(mean, 0.98), 4) AS vmax
FROM cells WHERE regexp_matches(prompt_id, '^P[0-9]+(_T[0-9]+)?$') GROUP BY metric""")
def q_robust_limits(spark, sf):
    c = cells(spark, sf).filter(M.is_prompt_id("prompt_id"))
    lim = C.robust_limits(c, ["metric"], "mean")
    return lim.select("metric", F.round("vmin", 4).alias("vmin"), F.round("vmax", 4).alias("vmax"))


# --- run_value_limits: AG17 over raw runs (each metric group holds half the rows) -------
@register("run_value_limits", _w(A.METRICS_SQL) + """
SELECT metric, round(quantile_cont(value, 0.02), 4) AS vmin, round(quantile_cont(value, 0.98), 4) AS vmax
FROM metric_rows GROUP BY metric""")
def q_run_value_limits(spark, sf):
    lim = C.robust_limits(metric_runs(spark, sf), ["metric"], "value", bounded=False)
    return lim.select("metric", F.round("vmin", 4).alias("vmin"), F.round("vmax", 4).alias("vmax"))


# --- stat_audit: AG18 ------------------------------------------------------------
@register("stat_audit", _w(A.METRICS_SQL, RANKED_SQL, """firsts AS (
  SELECT model, prompt_id, metric, list(value ORDER BY run_no) AS vals FROM ranked WHERE run_no <= 5
  GROUP BY model, prompt_id, metric),
padded AS (SELECT model, prompt_id, metric,
  list_concat(vals, [CAST(0 AS DOUBLE), 0, 0, 0, 0])[1:5] AS runs FROM firsts)""") + """
SELECT c.model, c.prompt_id, c.metric, c.n, c.mean AS stored_mean, c.variance AS stored_variance, c.stdev AS stored_stdev,
  round(m, 4) AS recomputed_mean, round(v, 4) AS recomputed_variance, round(sqrt(v), 4) AS recomputed_stdev,
  abs(m - c.mean) > 5e-5 AS mean_mismatch, abs(v - c.variance) > 5e-5 AS variance_mismatch, abs(sqrt(v) - c.stdev) > 5e-5 AS stdev_mismatch,
  abs(m - c.mean) > 5e-5 OR abs(v - c.variance) > 5e-5 OR abs(sqrt(v) - c.stdev) > 5e-5 AS mismatch
FROM cells c JOIN (SELECT *, list_avg(runs) AS m, list_var_samp(runs) AS v FROM padded) p
  ON c.model = p.model AND c.prompt_id = p.prompt_id AND c.metric = p.metric""")
def q_stat_audit(spark, sf):
    mr = metric_runs(spark, sf)
    return C.stat_audit(C.padded_runs(mr, KEYS, ORDER), C.cell_stats(mr, KEYS), KEYS)


# --- coverage_gaps: JN8 ----------------------------------------------------------
_PROMPTS_VALUES = ", ".join(f"('{p}')" for p in schemas.CANONICAL_PROMPTS)


@register("coverage_gaps", _w(A.RUNS_SQL, """r AS (
  SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY started_at, event_id) AS run_no FROM runs),
obs AS (SELECT model, prompt_id, CAST(run_no AS INTEGER) AS run_no FROM r WHERE run_no <= 5 AND NOT error)""",
    f"""plan AS (
  SELECT m.model, p.prompt_id, CAST(g.range AS INTEGER) AS run_no
  FROM (SELECT DISTINCT model FROM runs) m, (VALUES {_PROMPTS_VALUES}) p(prompt_id), range(1, 6) g)""") + """
SELECT * FROM plan p WHERE NOT EXISTS (
  SELECT 1 FROM obs o WHERE o.model = p.model AND o.prompt_id = p.prompt_id AND o.run_no = p.run_no)""")
def q_coverage_gaps(spark, sf):
    r = A.runs(spark, sf)
    obs = R.first_runs(r, ["model", "prompt_id"], ORDER, 5).filter(~F.col("error"))
    return C.coverage_gaps(obs, r, "model", schemas.CANONICAL_PROMPTS, 5)


# --- deadline_skipped: PF16 ------------------------------------------------------
CUTOFF = "2024-01-01 02:00:00"


@register("deadline_skipped", _w(A.RUNS_SQL) + f"""
SELECT model, prompt_id, min(started_at) >= TIMESTAMP '{CUTOFF}' AS skipped
FROM runs GROUP BY model, prompt_id""")
def q_deadline(spark, sf):
    started = A.runs(spark, sf).groupBy("model", "prompt_id").agg(F.min("started_at").alias("started"))
    return R.not_started_by(started, "started", CUTOFF).select("model", "prompt_id", "skipped")


# --- warmup_filter: PF4 ----------------------------------------------------------
@register("warmup_filter", _w(A.RUNS_SQL, """r AS (
  SELECT *, row_number() OVER (PARTITION BY model ORDER BY started_at, event_id) AS rn FROM runs)""") + """
SELECT model, prompt_id, count(*) AS n_timed FROM r
WHERE rn > 1 AND model NOT IN (SELECT model FROM r WHERE rn = 1 AND error)
GROUP BY model, prompt_id""")
def q_warmup(spark, sf):
    timed = R.drop_warmup(A.runs(spark, sf), "model", ORDER)
    return timed.groupBy("model", "prompt_id").agg(F.count(F.lit(1)).alias("n_timed"))


# --- token_cells: AG13, WN4 ------------------------------------------------------
@register("token_cells", _w(A.RUNS_SQL, """r AS (
  SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY started_at, event_id) AS rn FROM runs),
stops AS (SELECT model, prompt_id, min(rn) AS stop FROM r WHERE error GROUP BY model, prompt_id),
ok AS (SELECT r.* FROM r LEFT JOIN stops s ON r.model = s.model AND r.prompt_id = s.prompt_id
       WHERE s.stop IS NULL OR r.rn < s.stop)""") + """
SELECT model, prompt_id, count(*) AS n_runs, round(avg(eval_count), 4) AS gen_tokens_mean,
  array_to_string(list_transform(list(eval_count ORDER BY rn), lambda x: CAST(x AS VARCHAR)), ',') AS gen_tokens_runs,
  arg_min(user_id, rn) AS prompt_tokens,
  round(avg(event_id % 300), 4) AS thinking_chars_mean,
  round(avg(total_duration / 1e9), 4) AS wall_s_mean
FROM ok GROUP BY model, prompt_id""")
def q_token_cells(spark, sf):
    r = A.runs(spark, sf).select(
        "model", "prompt_id", "started_at", "event_id", "error",
        F.col("eval_count").alias("gen_tokens"), F.col("user_id").alias("prompt_tokens"),
        (F.col("event_id") % 300).alias("thinking_chars"),
        (F.col("total_duration") / F.lit(1e9)).alias("wall_s"))
    t = C.token_cells(r, ["model", "prompt_id"], ORDER, F.col("error"))
    return t.select(
        "model", "prompt_id", "n_runs", F.round("gen_tokens_mean", 4).alias("gen_tokens_mean"),
        F.array_join(F.transform("gen_tokens_runs", lambda x: x.cast("string")), ",").alias("gen_tokens_runs"),
        "prompt_tokens", F.round("thinking_chars_mean", 4).alias("thinking_chars_mean"),
        F.round("wall_s_mean", 4).alias("wall_s_mean"))


# --- token_chunks: AG13 for cells of any size --------------------------------------
CHUNK = 50


@register("token_chunks", _w(A.RUNS_SQL, """r AS (
  SELECT *, row_number() OVER (PARTITION BY model, prompt_id ORDER BY started_at, event_id) AS rn FROM runs),
ok AS (SELECT * FROM r WHERE rn < coalesce((SELECT min(rn) FROM r s WHERE s.error AND s.model = r.model AND s.prompt_id = r.prompt_id), 9223372036854775807))""") + f"""
SELECT model, prompt_id, (rn - 1) // {CHUNK} AS chunk, count(*) AS n,
  string_agg(CAST(eval_count AS VARCHAR), ',' ORDER BY rn) AS gen_tokens_runs
FROM ok GROUP BY model, prompt_id, chunk""")
def q_token_chunks(spark, sf):
    r = A.runs(spark, sf).withColumnRenamed("eval_count", "gen_tokens")
    t = C.token_chunks(r, ["model", "prompt_id"], ORDER, F.col("error"), size=CHUNK)
    return t.withColumn("gen_tokens_runs", F.array_join(F.transform("gen_tokens_runs", lambda x: x.cast("string")), ","))


# --- workload_time: AG19, SC8 ----------------------------------------------------
@register("workload_time", """
WITH s AS (SELECT event_type AS model, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS seconds
           FROM events GROUP BY event_type)
SELECT model, seconds, printf('%02d:%02d:%02d', seconds // 3600, (seconds % 3600) // 60, seconds % 60) AS duration
FROM s""")
def q_workload_time(spark, sf):
    ev = A.table(spark, sf, "events").withColumnRenamed("event_type", "model")
    s = C.workload_seconds(ev, "ts", ["model"])
    return s.select("model", "seconds", tx.hhmmss("seconds").alias("duration"))


# --- summary_report: SNK2, SC9 ---------------------------------------------------
@register("summary_report", _w(A.METRICS_SQL) + """
SELECT model, prompt_id, metric,
  printf('%.2f', mean) || ' ' || CASE WHEN metric = 'Tokens_Per_Sec' THEN 't/sec' ELSE 'seconds' END AS mean_text,
  printf('%.2f', stdev) AS sd_text
FROM cells""")
def q_summary_report(spark, sf):
    c = cells(spark, sf)
    return c.select("model", "prompt_id", "metric",
                    F.concat(tx.fmt("mean", 2), F.lit(" "), tx.metric_unit("metric")).alias("mean_text"),
                    tx.fmt("stdev", 2).alias("sd_text"))


# --- plot_data: SNK5, SR2, SC4, PV5 ----------------------------------------------
@register("plot_data", _w(A.METRICS_SQL, TPS_CELLS_SQL, """g AS (
  SELECT model, avg(mean) AS gm, stddev_samp(mean) AS sd FROM tps_cells GROUP BY model)""") + """
SELECT model,
  CASE WHEN strpos(model, ':') > 0
       THEN split_part(model, ':', 1) || chr(10) || substr(model, strpos(model, ':') + 1) || ' (---)'
       ELSE model || chr(10) || '(---)' END AS label,
  round(gm, 4) AS grand_mean, round(sd, 4) AS cross_prompt_sd,
  round(gm + coalesce(sd, 0), 4) AS annot_y,
  CAST(row_number() OVER (ORDER BY gm DESC NULLS LAST, model) AS INTEGER) AS bar_rank
FROM g""")
def q_plot_data(spark, sf):
    g = C.grand_mean(tps_cells(spark, sf), ["model"])
    base, suffix = tx.split_first("model")
    label = (F.when(suffix.isNotNull(), F.concat(base, F.lit("\n"), suffix, F.lit(" (---)")))
             .otherwise(F.concat(F.col("model"), F.lit("\n(---)"))))
    # the ranking runs over one row per model (a bounded, aggregated input)
    rank = F.row_number().over(Window.orderBy(F.desc_nulls_last("grand_mean"), "model"))
    return g.select("model", label.alias("label"), F.round("grand_mean", 4).alias("grand_mean"),
                    F.round("cross_prompt_sd", 4).alias("cross_prompt_sd"),
                    F.round(F.col("grand_mean") + F.coalesce("cross_prompt_sd", F.lit(0.0)), 4).alias("annot_y"),
                    rank.cast("int").alias("bar_rank"))


# --- prompt_selection: PF15, SO2, SR4 --------------------------------------------
REQUESTED_PROMPTS = ["P2", "P77", "P1", "P2", "P9_T5", "P13"]
_REQ_VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(REQUESTED_PROMPTS, 1))


@register("prompt_selection", _w(A.RUNS_SQL, f"req(req_ord, prompt_id) AS (VALUES {_REQ_VALUES})") + """
SELECT CAST(req_ord AS INTEGER) AS req_ord, prompt_id,
  prompt_id IN (SELECT DISTINCT prompt_id FROM runs) AS present
FROM req""")
def q_prompt_selection(spark, sf):
    present = A.runs(spark, sf)
    chosen, skipped = M.select_prompts(present, REQUESTED_PROMPTS)
    return (chosen.withColumn("present", F.lit(True))
            .unionByName(skipped.withColumn("present", F.lit(False))))


# --- canonical_prompts: PF15 (canonical list of the full table, as far as it was measured) ---
_CANON_VALUES = ", ".join(f"({i}, '{p}')" for i, p in enumerate(schemas.CANONICAL_PROMPTS, 1))


@register("canonical_prompts", _w(A.BIG_SQL, f"req(req_ord, prompt_id) AS (VALUES {_CANON_VALUES})") + """
SELECT CAST(req_ord AS INTEGER) AS req_ord, prompt_id, prompt_id IN (SELECT prompt_id FROM big) AS present FROM req""")
def q_canonical_prompts(spark, sf):
    chosen, skipped = M.select_prompts(A.big_runs(spark, sf), schemas.CANONICAL_PROMPTS)
    return chosen.withColumn("present", F.lit(True)).unionByName(skipped.withColumn("present", F.lit(False)))


# --- castable_cells: PF8 ---------------------------------------------------------
@register("castable_cells", _w(A.METRICS_SQL, """t AS (
  SELECT model, prompt_id, metric,
    CASE WHEN prompt_id = 'P3' THEN 'abc' WHEN prompt_id = 'P4' AND model = 'view' THEN 'nan'
         ELSE CAST(mean AS VARCHAR) END AS mean_text FROM cells),
p AS (SELECT model, prompt_id, metric, TRY_CAST(mean_text AS DOUBLE) AS v FROM t)""") + """
SELECT model, prompt_id, metric, CASE WHEN isnan(v) THEN NULL ELSE v END AS mean, isnan(v) AS is_nan
FROM p WHERE v IS NOT NULL""")
def q_castable(spark, sf):
    c = cells(spark, sf)
    t = c.select("model", "prompt_id", "metric",
                 F.when(F.col("prompt_id") == "P3", F.lit("abc"))
                 .when((F.col("prompt_id") == "P4") & (F.col("model") == "view"), F.lit("nan"))
                 .otherwise(F.col("mean").cast("string")).alias("mean_text"))
    return C.castable(t, "mean_text", "mean").select("model", "prompt_id", "metric", "mean", "is_nan")


# --- big_cell_stats: AG1 over a large run table (A4) -----------------------------
@register("big_cell_stats", _w(A.BIG_SQL) + """
SELECT model, prompt_id, count(*) AS n, round(round(avg(value), 9), 4) AS mean,
  round(coalesce(var_samp(value), 0), 4) AS variance, round(coalesce(stddev_samp(value), 0), 4) AS stdev
FROM big GROUP BY model, prompt_id""")
def q_big_cell_stats(spark, sf):
    return C.cell_stats(A.big_runs(spark, sf), ["model", "prompt_id"])


# --- size_first_last: AG4, AG5 ---------------------------------------------------
@register("size_first_last", _w(A.BIG_SQL) + """
SELECT model, first(size ORDER BY l_orderkey, l_linenumber, size) AS first_size,
  last(size ORDER BY l_orderkey, l_linenumber, size) AS last_size
FROM big GROUP BY model""")
def q_size_first_last(spark, sf):
    b = A.big_runs(spark, sf)
    order = ["l_orderkey", "l_linenumber"]
    return (C.first_value(b, ["model"], "size", order, "first_size")
            .join(C.last_value(b, ["model"], "size", order, "last_size"), "model"))


# --- labelled_matrix: PV5, JN7, AG4 ----------------------------------------------
@register("labelled_matrix", _w(A.BIG_SQL, """sz AS (SELECT model, first(size ORDER BY l_orderkey, l_linenumber, size) AS size
  FROM big GROUP BY model),
c AS (SELECT model, prompt_id, round(round(avg(value), 9), 4) AS mean, round(coalesce(stddev_samp(value), 0), 4) AS stdev
  FROM big GROUP BY model, prompt_id)""") + """
SELECT c.model || ' (' || coalesce(sz.size, '---') || ')' AS label, c.prompt_id, c.mean, c.stdev,
  round(CASE WHEN c.mean <> 0 THEN c.stdev / c.mean WHEN c.stdev = 0 THEN CAST('nan' AS DOUBLE)
        ELSE CAST('inf' AS DOUBLE) END, 4) AS cov
FROM c LEFT JOIN sz ON c.model = sz.model""")
def q_labelled_matrix(spark, sf):
    b = A.big_runs(spark, sf)
    sz = C.first_value(b, ["model"], "size", ["l_orderkey", "l_linenumber"])
    c = C.cell_stats(b, ["model", "prompt_id"])
    j = c.join(sz, "model", "left")
    return j.select(M.row_label("model", "size").alias("label"), "prompt_id", "mean", "stdev",
                    F.round(M.coefficient_of_variation("stdev", "mean"), 4).alias("cov"))
