"""Readers for the report files: commented cell CSV, sample JSON lines, keyed token
JSON, score files, and raw response records.

All readers take path globs and spread files over tasks; nothing is read on the
driver.  Schemas are fixed (no inference).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens import schemas
from runlens.functions import text as tx

_LINE_BREAK = r"\r?\n"


def _lines(spark: SparkSession, paths: str | Sequence[str], whole_file: bool = False) -> DataFrame:
    """(file, line_no, line) for every line of every file.

    Default: line mode, so a large file is split across tasks; ``line_no`` is the
    orderable pair (block start of the split, position within the split).
    ``whole_file``: one task per file, ``line_no`` = (0, position)."""
    if whole_file:
        raw = spark.read.text(paths, wholetext=True).select("value", F.col("_metadata.file_path").alias("file"))
        return raw.select("file", F.posexplode(F.split("value", _LINE_BREAK)).alias("pos", "line")) \
            .select("file", F.struct(F.lit(0).cast("bigint").alias("block"), F.col("pos").cast("bigint").alias("pos"))
                    .alias("line_no"), "line")
    raw = spark.read.text(paths)
    return raw.select(
        F.col("_metadata.file_path").alias("file"),
        F.struct(F.col("_metadata.file_block_start").alias("block"),
                 F.monotonically_increasing_id().alias("pos")).alias("line_no"),
        F.regexp_replace("value", r"\r$", "").alias("line"))


def _clean(line) -> Column:
    """``line.strip().strip('"')``."""
    return F.regexp_replace(tx.strip(line), r'^"+|"+$', "")


def _after(clean: Column, key: str) -> Column:
    """Text after the first occurrence of ``key`` (NULL when absent)."""
    return F.when(F.instr(clean, key) > 0,
                  F.substring(clean, F.instr(clean, key) + F.lit(len(key)), F.lit(1 << 30)))


def _cut(v: Column) -> Column:
    """Cut at the next ``#``, then at the next ``,``, then strip."""
    return tx.strip(F.substring_index(F.substring_index(v, "#", 1), ",", 1))


#: Columns a report line may have.
MAX_COLUMNS = 64
_POSITIONS = [f"c{i}" for i in range(MAX_COLUMNS)]
META = ("timestamp", "host", "gpu", "duration")


def _fields(line: Column) -> Column:
    """The fields of one CSV line, as an array."""
    r = F.from_csv(line, ", ".join(f"{c} STRING" for c in _POSITIONS))
    return F.array(*[r[c] for c in _POSITIONS])


def _meta_values(clean: Column) -> dict[str, Column]:
    """[SRC2] What a comment line says of each header value (null: nothing)."""
    host, gpu = F.instr(clean, "Host:") > 0, F.instr(clean, "GPU:") > 0
    return {
        "timestamp": _cut(_after(clean, "Timestamp:")),
        "host": F.when(host, _cut(_after(clean, "Host:"))).otherwise(tx.strip(_after(clean, "Host Node Name:"))),
        "gpu": F.when(gpu, _cut(_after(clean, "GPU:"))).otherwise(tx.strip(_after(clean, "Accelerator Info:"))),
        "duration": tx.strip(_after(clean, "Duration:")),
    }


def read_reports(spark: SparkSession, paths: str | Sequence[str], header: str = "first", meta_default: str = "") -> DataFrame:
    """[SRC1, SRC2] Commented cell CSV files in one pass: every cell row with its file, its place
    (``row_ord``), its columns by header name, and the file's ``meta`` (timestamp, host, gpu,
    duration).

    A file is one row: its header line is the first (``header='first'``) or last (``'last'``)
    line whose stripped text begins ``Model,`` (none: the first line); the lines after it are
    data, ``#`` lines among them; blank lines are skipped.  Columns are found by the names in
    the header line, in whatever order; one that is not there is null.  Every string column is
    stripped.  Of comment lines that say the same thing the last one counts.  Nothing is joined
    or grouped; reports hold one line a cell, so a file fits a row."""
    one = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.split("value", _LINE_BREAK).alias("lines"))
    one = one.withColumn("clean", F.transform("lines", _clean))
    marks = F.transform("clean", lambda c: c.startswith("Model,"))
    at = F.array_position(marks, True) if header == "first" else F.size("clean") + 1 - F.array_position(F.reverse(marks), True)
    one = one.withColumn("hdr", F.when(F.array_contains(marks, True), at.cast("int")).otherwise(F.lit(1)))
    one = one.withColumn("names", F.transform(_fields(F.element_at("lines", F.col("hdr"))), lambda n: _clean(n)))
    comments = F.filter("clean", lambda c: c.startswith("#"))
    for key in META:
        said = F.filter(F.transform(comments, lambda c: _meta_values(c)[key]), lambda v: v.isNotNull())  # noqa: B023 - built at once
        one = one.withColumn(key, F.coalesce(F.try_element_at(said, F.lit(-1)), F.lit(meta_default)))
    data = F.transform("lines", lambda line, i: F.struct((i + 1).alias("row_ord"), line.alias("line")))
    data = F.filter(data, lambda x: (x["row_ord"] > F.col("hdr")) & (tx.strip(x["line"]) != ""))
    rows = one.select("file", "names", F.struct(*META).alias("meta"), F.explode(data).alias("d"))
    return _named(rows.select("file", "names", "meta", "d.row_ord", _fields(F.col("d.line")).alias("fields")))


def read_report_meta(spark: SparkSession, paths: str | Sequence[str], meta_default: str = "", whole_file: bool = True) -> DataFrame:
    """[SRC2] One row a file: file, timestamp, host, gpu, duration, also of files without a cell.
    One aggregate over the comment lines' values, wherever a file's lines are."""
    lines = _lines(spark, paths, whole_file).withColumn("clean", _clean("line"))
    values = _meta_values(F.when(F.col("clean").startswith("#"), F.col("clean")))
    found = lines.select("file", "line_no", *[v.alias(k) for k, v in values.items()])
    last = [F.max_by(k, F.when(F.col(k).isNotNull(), F.col("line_no"))).alias(k) for k in META]
    return found.groupBy("file").agg(*last).fillna(meta_default, list(META))


def read_cell_csv(spark: SparkSession, paths: str | Sequence[str], header: str = "first",
                  meta_default: str = "", whole_file: bool = True) -> tuple[DataFrame, DataFrame]:
    """[SRC1, SRC2] :func:`read_reports` as two tables: (cells, meta), one row a file in meta.

    ``whole_file=False`` is for files too large for one row: they are split across tasks by
    line, and the header line found per file is joined back (skew is left to AQE)."""
    cells = read_reports(spark, paths, header, meta_default).drop("meta") if whole_file else _split_reports(spark, paths, header)
    return cells, read_report_meta(spark, paths, meta_default, whole_file)


def _split_reports(spark: SparkSession, paths: str | Sequence[str], header: str) -> DataFrame:
    lines = _lines(spark, paths).withColumn("clean", _clean("line"))
    is_header = F.col("clean").startswith("Model,")
    pick = F.min if header == "first" else F.max
    here = F.struct("line_no", "line")
    hdr = lines.groupBy("file").agg(F.coalesce(pick(F.when(is_header, here)), F.min(here)).alias("hdr"))
    hdr = hdr.select("file", F.col("hdr.line_no").alias("hdr"), F.transform(_fields(F.col("hdr.line")), lambda n: _clean(n)).alias("names"))
    data = lines.join(hdr, "file").filter((F.col("line_no") > F.col("hdr")) & (tx.strip("line") != ""))
    return _named(data.select("file", "names", F.col("line_no").alias("row_ord"), _fields(F.col("line")).alias("fields")))


def _named(rows: DataFrame) -> DataFrame:
    """The report's columns by header name, from (file, row_ord, names, fields, ...)."""
    place = {c: F.array_position("names", F.lit(c)).cast("int") for c in schemas.CSV_COLUMNS}
    got = {c: F.when(i > 0, F.element_at("fields", F.greatest(i, F.lit(1)))) for c, i in place.items()}
    more = [c for c in rows.columns if c not in ("file", "row_ord", "names", "fields")]
    return rows.select("file", "row_ord", *[(tx.strip(v) if k < 5 else v).alias(c) for k, (c, v) in enumerate(got.items())], *more)


def typed_cells(cells: DataFrame) -> DataFrame:
    """Normalise the text cells: numbers via ``try_cast`` (unparsable -> NULL)."""
    runs = F.array(*[F.col(f"Run_{i}").try_cast("double") for i in range(1, 6)])
    return cells.select(
        "file", "row_ord", F.col("Model").alias("model"), F.col("Size").alias("size"),
        F.col("Prompt_ID").alias("prompt_id"), F.col("Prompt_Name").alias("prompt_name"),
        F.col("Metric_Type").alias("metric"), runs.alias("runs"),
        F.col("Mean").try_cast("double").alias("mean"), F.col("Variance").try_cast("double").alias("variance"),
        F.col("Std_Dev").try_cast("double").alias("stdev"), *[c for c in cells.columns if c == "meta"])


def read_samples(spark: SparkSession, paths: str | Sequence[str], fail_fast: bool = True,
                 hive_dirs: bool = False) -> DataFrame:
    """[SRC3-SRC5] Sample JSON lines with a fixed schema; malformed line -> job error (FAILFAST).
    ``model`` comes from the parent directory name with ``__`` -> ``:``
    (``hive_dirs``: a ``key=`` prefix of the directory name is dropped)."""
    reader = spark.read.schema(schemas.SAMPLES).option("mode", "FAILFAST" if fail_fast else "PERMISSIVE")
    r = reader.json(paths)
    if not isinstance(paths, str) and len(paths) > 1:  # a file matched by two patterns is read once
        r = reader.json(sorted(set(r.inputFiles())) or list(paths))
    parent = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2)
    if hive_dirs:
        parent = F.url_decode(F.regexp_replace(parent, r"^[^=]*=", ""))
    # first leaf of either filtered layout: [["x"]] -> x, ["x"] -> x
    leaf = F.coalesce(F.get_json_object("filtered_resps", "$[0][0]"), F.get_json_object("filtered_resps", "$[0]"))
    return r.select("*", leaf.alias("filtered_first"), F.replace(parent, F.lit("__"), F.lit(":")).alias("model"),
                    F.col("_metadata.file_path").alias("file"))


def read_keyed_json(spark: SparkSession, paths: str | Sequence[str], value_type: T.DataType = schemas.TOKEN_CELLS,
                    whole_file: bool = True) -> DataFrame:
    """[SRC7] JSON object(s) keyed ``"model|prompt"`` -> one row per key with the key split.
    One object per file, indented or not (the default), or one object per line
    (``whole_file=False``).  Text that is not such an object fails the job."""
    raw = spark.read.text(paths, wholetext=whole_file).filter(F.trim(F.replace("value", F.lit("\n"), F.lit(" "))) != "")
    m = F.from_json("value", value_type)
    m = F.when(m.isNull(), F.raise_error(F.lit("not a JSON object keyed by model and prompt"))).otherwise(m)
    e = raw.select(F.explode(m).alias("key", "v"))
    parts = F.split("key", r"\|", 2)
    return e.select(F.element_at(parts, 1).alias("model"), F.try_element_at(parts, F.lit(2)).alias("prompt_id"), "v.*")


def read_score_files(spark: SparkSession, paths: str | Sequence[str], multi_line: bool = True) -> DataFrame:
    """[SRC8] Score files ``{results: {task: {metric: value}}, config: {model, model_args}}``
    -> (model, task, metric, value); a metric whose value is text has a NULL value."""
    r = spark.read.schema(schemas.SCORE_FILE).option("multiLine", multi_line).option("mode", "FAILFAST").json(paths)
    t = r.select(F.col("config.model").alias("model"), F.explode("results").alias("task", "metrics"))
    return t.select("model", "task", F.explode("metrics").alias("metric", "_v")) \
        .select("model", "task", "metric", F.col("_v").try_cast("double").alias("value"))


# Response records arrive in three layouts: fields at top level, nested under
# ``response``, or under ``model_dump``.
_FIELDS = T.StructType([
    T.StructField("eval_count", T.LongType()),
    T.StructField("prompt_eval_count", T.LongType()),
    T.StructField("eval_duration", T.LongType()),
    T.StructField("total_duration", T.LongType()),
    T.StructField("message", schemas.MESSAGE),
])
RESPONSE_JSON = T.StructType(list(_FIELDS.fields) + [
    T.StructField("response", _FIELDS), T.StructField("model_dump", _FIELDS)])


def parse_responses(df: DataFrame, json_col: str) -> DataFrame:
    """[SRC6] Extract the response fields from any of the three layouts (absent -> NULL)."""
    j = F.from_json(F.col(json_col), RESPONSE_JSON)
    out = df.withColumn("_r", j)
    fields = [f.name for f in _FIELDS.fields]
    return out.select(*[c for c in df.columns], *[
        F.coalesce(F.col(f"_r.{f}"), F.col(f"_r.response.{f}"), F.col(f"_r.model_dump.{f}")).alias(f)
        for f in fields])

