"""Fixed schemas and fixed values.

Schemas are declared, never inferred.  The fixed values below must equal the
behaviour being reproduced (prompt order, metric names, verdict names); they are
stated once here, in natural order.
"""

from __future__ import annotations

from pyspark.sql import types as T

# ---------------------------------------------------------------------------
# Fixed values
# ---------------------------------------------------------------------------

# Metric names as written in the cell CSV.
TPS = "Tokens_Per_Sec"
ELAPSED = "Elapsed_Sec"
METRICS = [TPS, ELAPSED]

# Canonical prompt order of the full table (single-turn prompts, sampled dialogue
# turns, then the last prompt).
CANONICAL_PROMPTS = [
    "P1", "P2", "P3", "P4", "P5", "P6",
    "P7", "P8", "P9_T1", "P9_T3", "P9_T5", "P10",
]
# Prompts of the short summary table, in that table's order.
SUMMARY_PROMPTS = ["P1", "P2", "P4", "P5", "P9_T5", "P10"]
# Dialogue turns that are measured (1-based).
SAMPLED_TURNS = [1, 3, 5]

# Triage verdicts, in report order.
VERDICTS = ["EMPTY_GENERATION", "WRONG_BLOCK", "MODEL_SELF_TEST", "GENUINE_FAILURE"]

# Prompt-id predicate.
PROMPT_ID_PATTERN = r"^P[0-9]+(_T[0-9]+)?$"

# Cell CSV header.
CSV_COLUMNS = [
    "Model", "Size", "Prompt_ID", "Prompt_Name", "Metric_Type",
    "Run_1", "Run_2", "Run_3", "Run_4", "Run_5", "Mean", "Variance", "Std_Dev",
]
RUNS_EXPORTED = 5
MISSING_CELL = "---"
UNKNOWN_SIZE = "Unknown"

# ---------------------------------------------------------------------------
# Schemas
# ---------------------------------------------------------------------------

MESSAGE = T.StructType([
    T.StructField("role", T.StringType()),
    T.StructField("content", T.StringType()),
    T.StructField("thinking", T.StringType()),
])

# One inference call (batch table or stream).
RESPONSES = T.StructType([
    T.StructField("run_set", T.StringType()),
    T.StructField("model", T.StringType()),
    T.StructField("prompt_id", T.StringType()),
    T.StructField("run_no", T.IntegerType()),
    T.StructField("turn", T.IntegerType()),
    T.StructField("phase", T.StringType()),
    T.StructField("started_at", T.TimestampType()),
    T.StructField("eval_count", T.LongType()),
    T.StructField("prompt_eval_count", T.LongType()),
    T.StructField("eval_duration", T.LongType()),
    T.StructField("total_duration", T.LongType()),
    T.StructField("message", MESSAGE),
    T.StructField("error", T.BooleanType()),
])

# Cell CSV data line (all text; numbers are cast explicitly by the reader).
CSV_LINE_DDL = ", ".join(f"`{c}` STRING" for c in CSV_COLUMNS)

DOC = T.StructType([
    T.StructField("task_id", T.StringType()),
    T.StructField("prompt", T.StringType()),
    T.StructField("test", T.StringType()),
    T.StructField("entry_point", T.StringType()),
])

# One generation sample (JSON lines).
SAMPLES = T.StructType([
    T.StructField("doc_id", T.LongType()),
    T.StructField("doc", DOC),
    T.StructField("resps", T.ArrayType(T.ArrayType(T.StringType()))),
    # two layouts exist (array<string> or array<array<string>>): kept as raw JSON text
    T.StructField("filtered_resps", T.StringType()),
    T.StructField("pass@1", T.DoubleType()),
])

# Token-count cells, a JSON object keyed "model|prompt".
TOKEN_CELL = T.StructType([
    T.StructField("gen_tokens_mean", T.DoubleType()),
    T.StructField("gen_tokens_runs", T.ArrayType(T.LongType())),
    T.StructField("prompt_tokens", T.LongType()),
    T.StructField("thinking_chars_mean", T.DoubleType()),
    T.StructField("wall_s_mean", T.DoubleType()),
])
TOKEN_CELLS = T.MapType(T.StringType(), TOKEN_CELL)

# Score file: per task a map of metric -> value, plus config.
SCORE_FILE = T.StructType([
    T.StructField("results", T.MapType(T.StringType(), T.MapType(T.StringType(), T.StringType()))),
    T.StructField("config", T.StructType([
        T.StructField("model", T.StringType()),
        T.StructField("model_args", T.StringType()),
    ])),
])
