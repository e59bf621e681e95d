"""Views of the driver test tables in the shapes the operators expect.

The driver tables hold no model responses, so each adapter derives one
deterministically from a table (the same expressions are written once for Spark
and once as a DuckDB SQL CTE for the oracle).  Every adapter reads the whole
table.

A1 runs     <- events                  (one row per inference attempt)
A2 samples  <- documents JOIN labels   (one generation sample per labelled doc)
A3 turns    <- conversations           (dialogue messages)
A4 big      <- lineitem                (many runs per cell)
A5 manifest <- part                    (served model names and sizes)
A6 outcomes <- labels JOIN documents   (re-execution outcome per doc)
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def _plans(spark: SparkSession) -> dict:
    """Plans built for a session, kept on the session itself, so they end with it."""
    return spark.__dict__.setdefault("_runlens_plans", {})


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The driver table as a DataFrame (file listing and footer schema read once per
    session and path; the DataFrame is an immutable plan, not cached data)."""
    path, plans = f"{sf_dir.rstrip('/')}/{name}.parquet", _plans(spark)
    if path not in plans:
        plans[path] = spark.read.parquet(path)
    return plans[path]


def texts(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A text table; its splits are sized by ``spark.sql.files.maxPartitionBytes``."""
    return table(spark, sf_dir, name)


def memo(fn):
    """Reuse an adapter's DataFrame per (session, sf_dir): it is an immutable plan
    over read-only tables, so building it once saves repeated analysis."""

    def wrapper(spark: SparkSession, sf_dir: str) -> DataFrame:
        key, plans = (fn.__name__, sf_dir.rstrip("/")), _plans(spark)
        if key not in plans:
            plans[key] = fn(spark, sf_dir)
        return plans[key]

    wrapper.__name__, wrapper.__doc__ = fn.__name__, fn.__doc__
    return wrapper


def sql_lit(s: str) -> str:
    """A Python string as a DuckDB string literal (raw newlines are allowed)."""
    return "'" + s.replace("'", "''") + "'"


# ---------------------------------------------------------------------------
# A1 runs <- events
# ---------------------------------------------------------------------------

@memo
def runs_with_props(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A1 with the event's own ``props`` text beside it."""
    ev = table(spark, sf_dir, "events")
    slot = F.get_json_object("props", "$.k").cast("int") % 12
    prompt = (F.when(slot == 8, "P9_T1").when(slot == 9, "P9_T3").when(slot == 10, "P9_T5")
              .when(slot == 11, "P10").otherwise(F.concat(F.lit("P"), (slot + 1).cast("string"))))
    eval_ns = F.round(F.col("value") * 100).cast("bigint") * F.lit(10000000)
    return ev.select(
        F.col("event_type").alias("model"),
        prompt.alias("prompt_id"),
        "event_id",
        F.col("ts").alias("started_at"),
        F.col("user_id"),
        (F.col("event_id") % 997).alias("eval_count"),
        eval_ns.alias("eval_duration"),
        (eval_ns + F.col("user_id") * F.lit(1000000)).alias("total_duration"),
        (F.col("event_id") % 41 == 0).alias("error"),
        "props",
    )


@memo
def runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs_with_props(spark, sf_dir).drop("props")


def runs_sql(suffix: str = "", where: str = "") -> str:
    """A1 as a DuckDB CTE named ``runs{suffix}``."""
    cond = f" WHERE {where}" if where else ""
    return f"""runs{suffix} AS (
  SELECT event_type AS model,
    CASE CAST(json_extract_string(props, '$.k') AS INTEGER) % 12
      WHEN 8 THEN 'P9_T1' WHEN 9 THEN 'P9_T3' WHEN 10 THEN 'P9_T5' WHEN 11 THEN 'P10'
      ELSE 'P' || CAST(CAST(json_extract_string(props, '$.k') AS INTEGER) % 12 + 1 AS VARCHAR) END AS prompt_id,
    event_id, ts AS started_at, user_id,
    event_id % 997 AS eval_count,
    CAST(round(value * 100) AS BIGINT) * 10000000 AS eval_duration,
    CAST(round(value * 100) AS BIGINT) * 10000000 + user_id * 1000000 AS total_duration,
    (event_id % 41 = 0) AS error
  FROM events{cond})"""


def metrics_sql(suffix: str = "", where: str = "") -> str:
    """PF1-PF3, PV6 and AG1 on A1 as DuckDB CTEs ``measured``, ``metric_rows``, ``cells``
    (each with ``suffix``); a failed attempt gives 0.0 for both metrics."""
    s = suffix
    return runs_sql(s, where) + f""",
measured{s} AS (
  SELECT *,
    CASE WHEN error THEN CAST(0 AS DOUBLE) WHEN eval_duration > 0 THEN eval_count / (eval_duration / 1e9)
         ELSE CAST(0 AS DOUBLE) END AS tps,
    CASE WHEN error THEN CAST(0 AS DOUBLE) WHEN total_duration > 0 THEN total_duration / 1e9
         ELSE CAST(0 AS DOUBLE) END AS elapsed
  FROM runs{s}),
metric_rows{s} AS (
  SELECT model, prompt_id, event_id, started_at, 'Tokens_Per_Sec' AS metric, tps AS value FROM measured{s}
  UNION ALL
  SELECT model, prompt_id, event_id, started_at, 'Elapsed_Sec' AS metric, elapsed AS value FROM measured{s}),
cells{s} AS (
  SELECT model, prompt_id, metric, count(*) AS n, round(round(avg(value), 9), 4) AS mean,
    round(coalesce(var_samp(value), 0), 4) AS variance, round(coalesce(stddev_samp(value), 0), 4) AS stdev
  FROM metric_rows{s} GROUP BY model, prompt_id, metric)"""


RUNS_SQL = runs_sql()
METRICS_SQL = metrics_sql()


# ---------------------------------------------------------------------------
# A7 fleet runs <- events: the same attempts under served names such as ``SRC7:q8_0``
# (two quantisations of 22 families; four of them have no samples, two sampled models no runs)
# ---------------------------------------------------------------------------

@memo
def fleet_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    tag = F.when(F.col("event_id") % 2 == 0, F.lit(":q4_K_M")).otherwise(F.lit(":q8_0"))
    served = F.concat(F.lit("SRC"), (F.col("user_id") % 22 + 2).cast("string"), tag)
    return runs(spark, sf_dir).select(served.alias("served"), "event_id", "eval_count", "eval_duration", "total_duration")


FLEET_SQL = RUNS_SQL + """,
fleet AS (SELECT 'SRC' || CAST(user_id % 22 + 2 AS VARCHAR) || CASE WHEN event_id % 2 = 0 THEN ':q4_K_M' ELSE ':q8_0' END AS served,
    event_id, eval_count, eval_duration, total_duration FROM runs)"""


# ---------------------------------------------------------------------------
# A2 samples <- documents LEFT JOIN labels (no label: no pass_at_1, neither passed nor failed)
# ---------------------------------------------------------------------------

# Reply forms, by doc_id % 7.  Each form is a list of pieces: plain strings are
# fixed text, "{T}" is the whole document text, "{EP}" the entry point name.
REPLY_FORMS: list[list[str]] = [
    # 0: solution block, then an example block (the last block is the wrong one)
    ["{T}", "\n```python\ndef ", "{EP}", "(x):\n    return x\n```\nExample:\n```\nprint(1)\n```\n"],
    # 1: reasoning holding a block, then the solution followed by the model's own assert
    ["<THINK>", "{T}", "\n```python\nbad\n```</think>\n```python\ndef ", "{EP}",
     "(x):\n    return x\nassert True\n```\n"],
    # 2: blank
    [" \n "],
    # 3: opener that is never closed
    ["```python\ndef g(x):\n    return ??\n", "{T}"],
    # 4: prose only
    ["?? ", "{T}"],
    # 5: unsupported tag; its closing fence then opens a block
    ["{T}", "\n```py\na=1\n```\nmid\n```\nb\n```"],
    # 6: one clean solution block
    ["{T}", "\n```python\ndef ", "{EP}", "(x):\n    return x\n```"],
]
N_FORMS = len(REPLY_FORMS)
N_TASKS = 164


def _pieces_spark(pieces: list[str]):
    parts = []
    for p in pieces:
        if p == "{T}":
            parts.append(F.col("text"))
        elif p == "{EP}":
            parts.append(F.col("entry_point"))
        else:
            parts.append(F.lit(p))
    return F.concat(*parts)


def _pieces_sql(pieces: list[str]) -> str:
    out = []
    for p in pieces:
        if p == "{T}":
            out.append("d.text")
        elif p == "{EP}":
            out.append("('f' || CAST(d.doc_id % 164 AS VARCHAR))")
        else:
            out.append(sql_lit(p))
    return " || ".join(out)


def reply_column():
    form = F.col("doc_id") % N_FORMS
    expr = None
    for i, pieces in enumerate(REPLY_FORMS):
        expr = (F.when(form == i, _pieces_spark(pieces)) if expr is None
                else expr.when(form == i, _pieces_spark(pieces)))
    return expr


def reply_sql() -> str:
    whens = "\n      ".join(f"WHEN {i} THEN {_pieces_sql(p)}" for i, p in enumerate(REPLY_FORMS))
    return f"CASE d.doc_id % 7\n      {whens} END"


@memo
def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, doc_id, form, task_id (NULL for doc_id % 5 = 0), entry_point, reply, pass_at_1, resps,
    filtered_resps, stub, hidden_test."""
    docs = texts(spark, sf_dir, "documents").select("doc_id", "text", "source")
    lab = table(spark, sf_dir, "labels").select("doc_id", "quality")
    j = docs.join(lab, "doc_id", "left")
    ep = F.concat(F.lit("f"), (F.col("doc_id") % N_TASKS).cast("string"))
    return (
        j.withColumn("entry_point", ep)
        .withColumn("reply", reply_column())
        .select(
            F.col("source").alias("model"),
            "doc_id",
            (F.col("doc_id") % N_FORMS).cast("int").alias("form"),
            F.when(F.col("doc_id") % 5 == 0, F.lit(None).cast("string"))
            .otherwise(F.concat(F.lit("task/"), (F.col("doc_id") % N_TASKS).cast("string"))).alias("task_id"),
            "entry_point",
            "reply",
            F.col("quality").cast("double").alias("pass_at_1"),
            F.array(F.array("reply")).alias("resps"),
            F.array("reply").alias("filtered_resps"),
            F.concat(F.lit("def "), F.col("entry_point"), F.lit("(x):\n    \"\"\"Return x.\"\"\"\n")).alias("stub"),
            F.concat(F.lit("def check(candidate):\n    assert candidate(1) == 1\n")).alias("hidden_test"),
        )
    )


def samples_sql() -> str:
    return f"""samples AS (
  SELECT d.source AS model, d.doc_id, CAST(d.doc_id % 7 AS INTEGER) AS form,
    CASE WHEN d.doc_id % 5 = 0 THEN NULL ELSE 'task/' || CAST(d.doc_id % 164 AS VARCHAR) END AS task_id,
    'f' || CAST(d.doc_id % 164 AS VARCHAR) AS entry_point,
    {reply_sql()} AS reply,
    CAST(l.quality AS DOUBLE) AS pass_at_1
  FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id)"""


# ---------------------------------------------------------------------------
# A3 turns <- conversations
# ---------------------------------------------------------------------------

@memo
def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return texts(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")


# ---------------------------------------------------------------------------
# A8 dialogue runs <- conversations: user turns as measured turns of a model's dialogue
# ---------------------------------------------------------------------------

@memo
def dialogue_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, conv_id, turn, eval_count, eval_duration, total_duration (of short texts not
    positive), failed; a turn's text decides its numbers."""
    size = F.length("text").cast("bigint")
    t = turns(spark, sf_dir).filter(F.col("role") == "user")
    return t.select(
        F.concat(F.lit("dialogue-"), (F.col("conv_id") % 5).cast("string")).alias("model"), "conv_id", "turn",
        size.alias("eval_count"), (size * F.lit(1000000)).alias("eval_duration"), ((size - 40) * F.lit(7001237)).alias("total_duration"),
        (size % 13 == 0).alias("failed"))


# ---------------------------------------------------------------------------
# A9 responses under token budgets <- documents: the text's words are reasoning, then an
# answer follows if the budget allows; doc_id % 7 = 2 says nothing at all
# ---------------------------------------------------------------------------

TOKEN_BUDGETS = (4096, 16384)


@memo
def budget_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """model, task, item, budget, run_no, thinking_tokens, gen_tokens, content."""
    from runlens.functions.text import word_count

    blank = F.col("doc_id") % 7 == 2
    d = texts(spark, sf_dir, "documents").select(
        F.col("source").alias("model"), F.coalesce("lang", F.lit("?")).alias("task"), F.col("doc_id").alias("item"),
        F.when(blank, F.lit(0)).otherwise(word_count("text")).alias("reasoning"), blank.alias("blank"))
    d = d.select("*", F.explode(F.array(*map(F.lit, TOKEN_BUDGETS))).alias("budget"))
    answer = F.when(F.col("blank"), F.lit(0)).otherwise(1 + F.col("item") % 50)
    return d.select(
        "model", "task", "item", "budget", F.lit(1).alias("run_no"), F.least("reasoning", "budget").alias("thinking_tokens"),
        F.least(F.col("budget"), F.col("reasoning") + answer).cast("bigint").alias("gen_tokens"),
        F.when(F.col("blank") | (F.col("reasoning") >= F.col("budget")), F.lit(" \n")).otherwise(F.lit("answer")).alias("content"))


# ---------------------------------------------------------------------------
# A4 big cells <- lineitem
# ---------------------------------------------------------------------------

@memo
def big_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        F.concat("l_returnflag", "l_linestatus").alias("model"),
        F.concat(F.lit("P"), F.col("l_linenumber").cast("string")).alias("prompt_id"),
        F.concat(F.col("l_quantity").cast("int").cast("string"), F.lit(" GB")).alias("size"),
        F.col("l_extendedprice").alias("value"),
        "l_orderkey", "l_linenumber",
    )


BIG_SQL = """big AS (
  SELECT l_returnflag || l_linestatus AS model, 'P' || CAST(l_linenumber AS VARCHAR) AS prompt_id,
    CAST(CAST(l_quantity AS INTEGER) AS VARCHAR) || ' GB' AS size, l_extendedprice AS value,
    l_orderkey, l_linenumber
  FROM lineitem)"""


# ---------------------------------------------------------------------------
# A5 manifest <- part
# ---------------------------------------------------------------------------

@memo
def manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    name = F.concat(F.replace(F.col("p_brand"), F.lit("Brand#"), F.lit("b")), F.lit(":"),
                    F.replace(F.col("p_name"), F.lit(" "), F.lit("-")))
    return (p.select(name.alias("name"), "p_size")
            .groupBy("name").agg((F.max("p_size").cast("bigint") * F.lit(100000000)).alias("size_bytes")))


MANIFEST_SQL = """manifest AS (
  SELECT replace(p_brand, 'Brand#', 'b') || ':' || replace(p_name, ' ', '-') AS name,
    CAST(max(p_size) AS BIGINT) * 100000000 AS size_bytes
  FROM part GROUP BY 1)"""

# Requested model names b1 .. b30 (some brands do not exist).
REQUESTED_MODELS = [f"b{i}" for i in range(1, 31)]


def requested(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, m) for i, m in enumerate(REQUESTED_MODELS, 1)], "ord int, model string")


def requested_sql() -> str:
    vals = ", ".join(f"({i}, '{m}')" for i, m in enumerate(REQUESTED_MODELS, 1))
    return f"requested(ord, model) AS (VALUES {vals})"


# ---------------------------------------------------------------------------
# A6 outcomes <- labels JOIN documents
# ---------------------------------------------------------------------------

@memo
def outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Re-execution outcome per sample: passed = not toxic.  A sample that is both
    low-quality and toxic was never re-executed, so it has no outcome (exercises the
    missing-outcome rule)."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "lang")
    lab = table(spark, sf_dir, "labels").select("doc_id", "toxic", "quality")
    return (docs.join(lab, "doc_id").filter(~((F.col("quality") == 0) & (F.col("toxic") == 1)))
            .select(F.col("source").alias("model"), "doc_id", "lang", F.lit(1).alias("attempt"),
                    (F.col("toxic") == 0).alias("passed")))


OUTCOMES_SQL = """outcomes AS (
  SELECT d.source AS model, d.doc_id, d.lang, 1 AS attempt, (l.toxic = 0) AS passed
  FROM documents d JOIN labels l ON d.doc_id = l.doc_id WHERE NOT (l.quality = 0 AND l.toxic = 1))"""
