"""Writers: the commented cell CSV (one file per run set), sample JSON lines, keyed
token JSON and score files.  Every writer is a distributed ``DataFrame.write``;
run sets / models are separated by ``partitionBy`` and lines are ordered within
each output partition, so no result passes through the driver."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import text as tx
from runlens.operators.runs import null_safe_join


def csv_field(c) -> F.Column:
    """Minimal CSV quoting as Python's csv writer does it: quote a field only when it
    holds the delimiter, a quote or a line break (quotes doubled).  Spark's CSV
    writer also quotes a leading field that starts with ``#``, which would change
    the comment rows."""
    c = F.coalesce(c, F.lit(""))
    return F.when(c.rlike('[,"\r\n]'), F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('""')), F.lit('"'))) \
        .otherwise(c)


def csv_line(*cols) -> F.Column:
    return F.concat_ws(",", *[csv_field(c) for c in cols])


def cell_csv_lines(cells: DataFrame, run_set: str = "run_set", title: str = "# INFERENCE BENCHMARK REPORT",
                   timestamp: str = "timestamp", host: str = "host", gpu: str = "gpu") -> DataFrame:
    """[SNK1] (run_set, ord, line) for the cell CSV: two comment rows, the header, then one
    row per cell ordered by ``row_ord``; runs padded/cut to 5 (the ``runs`` array is
    already padded), stats as 4-decimal text.

    ``cells``: run_set, row_ord, model, size, prompt_id, prompt_name, metric, runs,
    mean, variance, stdev, timestamp, host, gpu."""
    runs = [F.col("runs")[i].cast("string") for i in range(schemas.RUNS_EXPORTED)]
    fields = [F.col("model"), F.col("size"), F.col("prompt_id"), F.col("prompt_name"), F.col("metric"), *runs,
              tx.fmt("mean", 4), tx.fmt("variance", 4), tx.fmt("stdev", 4)]
    row = csv_line(*fields)
    data = cells.select(run_set, F.col("row_ord").cast("bigint").alias("ord"), row.alias("line"))
    meta = cells.groupBy(run_set).agg(F.first(timestamp).alias("ts"), F.first(host).alias("h"), F.first(gpu).alias("g"))
    second = csv_line(F.concat(F.lit("# Timestamp: "), F.col("ts")), F.concat(F.lit("# Host: "), F.col("h")),
                      F.concat(F.lit("# GPU: "), F.col("g")))
    pre = meta.select(run_set, F.explode(F.array(
        F.struct(F.lit(-3).cast("bigint").alias("ord"), F.lit(title).alias("line")),
        F.struct(F.lit(-2).cast("bigint").alias("ord"), second.alias("line")),
        F.struct(F.lit(-1).cast("bigint").alias("ord"), F.lit(",".join(schemas.CSV_COLUMNS)).alias("line")),
    )).alias("p")).select(run_set, "p.ord", "p.line")
    return pre.unionByName(data)


def write_cell_csv(cells: DataFrame, path: str, run_set: str = "run_set") -> None:
    """[SNK1] One CSV file per run set under ``path/run_set=<value>/``."""
    lines = cell_csv_lines(cells, run_set)
    (lines.repartition(run_set).sortWithinPartitions(run_set, "ord")
     .select(run_set, "line").write.mode("overwrite").partitionBy(run_set).text(path))


def write_samples(samples: DataFrame, path: str, model_dir: str = "model_dir") -> None:
    """Sample JSON lines, one directory per model (``:`` written as ``__``)."""
    out = samples.withColumn(model_dir, F.replace(F.col("model"), F.lit(":"), F.lit("__"))).drop("model")
    out.write.mode("overwrite").partitionBy(model_dir).json(path)


def write_keyed_json(cells: DataFrame, path: str, key_cols=("model", "prompt_id"), value_cols=(), per_file: str | None = None) -> None:
    """Cells as JSON objects keyed ``"model|prompt"``.  ``per_file``: one object per value of that
    key column (a model's cells, bounded by its prompts), each in a file of its own; otherwise
    one object per line, a stream of small maps for any number of cells."""
    key = F.concat_ws("|", *[F.col(c) for c in key_cols])
    if per_file is None:
        cells.select(F.to_json(F.create_map(key, F.struct(*value_cols))).alias("value")).write.mode("overwrite").text(path)
        return
    entry = F.struct(key.alias("key"), F.struct(*value_cols).alias("value"))
    objects = cells.groupBy(F.col(per_file).alias("part_of")).agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(entry)))).alias("value"))
    objects.write.mode("overwrite").partitionBy("part_of").text(path)


def write_score_files(scores: DataFrame, path: str, per_file: str | None = None) -> None:
    """Score files: results map + config.  ``per_file``: one file per value of that column
    (one object each); otherwise one object per line."""
    if per_file is None:
        scores.write.mode("overwrite").json(path)
    else:
        scores.withColumn("part_of", F.col(per_file)).repartition("part_of").write.mode("overwrite").partitionBy("part_of").json(path)


def table_rows(cells: DataFrame, prompts, row_keys=("model", "row_metric"), prompt_col: str = "prompt_id",
               fmt_fn=tx.mean_pm_sd, missing: str = schemas.MISSING_CELL, order_col: str | None = None) -> DataFrame:
    """[SNK3, UD4] Publication rows: one string per (model, metric row), cells in the given prompt
    order joined by `` & ``, ``missing`` where a prompt has no cell, the escaped
    model label first.  ``fmt_fn(mean, sd) -> Column`` formats a cell.

    Cells are first reduced to one per (row, prompt) -- the last by ``order_col`` when
    given -- and only the listed prompts are kept, so the per-row map is bounded by
    the prompt list."""
    c = cells.filter(F.col(prompt_col).isin(*prompts)).select(
        *row_keys, prompt_col, fmt_fn(F.col("mean"), F.col("stdev")).alias("_cell"),
        (F.col(order_col) if order_col else F.lit(0)).alias("_ord"))
    one = c.groupBy(*row_keys, prompt_col).agg(F.max_by("_cell", "_ord").alias("_cell"))
    g = one.groupBy(*row_keys).agg(F.map_from_entries(F.collect_list(F.struct(prompt_col, "_cell"))).alias("_m"))
    joined = F.array_join(F.transform(F.array(*[F.lit(p) for p in prompts]),
                                      lambda p: F.coalesce(F.element_at("_m", p), F.lit(missing))), " & ")
    label = F.concat(F.lit("\\textbf{\\texttt{"), tx.tex_escape(row_keys[0]), F.lit("}}"))
    return g.select(*row_keys, F.concat(label, F.lit(" & "), F.col(row_keys[1]), F.lit(" & "), joined,
                                        F.lit(" \\\\")).alias("row_text"))


#: How a publication row writes its parts.
ROW_LABELS = {"tps": r"$\bar{X}_{\text{TPS}} \pm \sigma$", "elap": r"$\bar{T}_{\text{Elap}} \pm \sigma$"}
SPAN_OPEN, EMPTY_CELL, SEPARATOR = r"\multirow{2}{*}{", r"\multicolumn{1}{c}{---}", r"    \midrule"


def tex_mean_sd(mean: F.Column, sd: F.Column) -> F.Column:
    return F.concat(F.lit("$"), tx.fmt1(mean), F.lit(r" \pm "), tx.fmt1(sd), F.lit("$"))


def publication_rows(cells: DataFrame, prompts: Sequence[str], fmt_fn=tex_mean_sd, missing: str = EMPTY_CELL) -> DataFrame:
    """[SNK3, WN1] The body of a publication table as ordered rows (seq, model, kind, row_text).

    ``cells``: model, size, prompt_id, metric, mean, stdev and ``row_ord``, the place of a cell
    in its source.  Models stand in first-seen order with two rows each: throughput, with
    label and size spanning both, then elapsed (any other metric); a separator stands before
    every model but the first.  A repeated cell is the last one, the size the first one seen.
    Only the listed prompts are gathered, so a row is bounded by the list; the rank is taken
    over one row a model."""
    metric = F.when(F.col("metric") == schemas.TPS, F.lit("tps")).otherwise(F.lit("elap"))
    models = cells.groupBy("model").agg(F.min("row_ord").alias("first"), F.min_by("size", "row_ord").alias("size"))
    models = models.withColumn("nth", F.row_number().over(Window.orderBy("first", "model")))
    shown = cells.filter(F.col("prompt_id").isin(*prompts)).withColumn("kind", metric)
    text = fmt_fn(F.col("mean"), F.col("stdev"))
    one = shown.groupBy("model", "kind", "prompt_id").agg(F.max_by(text, "row_ord").alias("cell"))
    by = one.groupBy("model").agg(*[
        F.map_from_entries(F.collect_list(F.when(F.col("kind") == k, F.struct("prompt_id", "cell")))).alias(k) for k in ROW_LABELS])

    def line(kind: str, head: F.Column) -> F.Column:
        row = F.transform(F.array(*map(F.lit, prompts)), lambda p: F.coalesce(F.element_at(kind, p), F.lit(missing)))
        return F.concat(F.lit("    "), head, F.lit(f" & {ROW_LABELS[kind]} & "), F.array_join(row, " & "), F.lit(r" \\"))

    label = F.concat(F.lit(r"\textbf{\texttt{"), tx.tex_escape("model"), F.lit("}}"))
    size = tx.tex_escape(F.coalesce("size", F.lit(schemas.MISSING_CELL)))
    head = F.concat(F.lit(SPAN_OPEN), label, F.lit("} & " + SPAN_OPEN), size, F.lit("}"))
    rows = F.array(
        F.when(F.col("nth") > 1, F.struct(F.lit(0).alias("k"), F.lit("separator").alias("kind"), F.lit(SEPARATOR).alias("row_text"))),
        F.struct(F.lit(1).alias("k"), F.lit("tps").alias("kind"), line("tps", head).alias("row_text")),
        F.struct(F.lit(2).alias("k"), F.lit("elap").alias("kind"), line("elap", F.lit("&")).alias("row_text")),
    )
    each = null_safe_join(models, by, ["model"], "left").select("model", "nth", F.explode(F.array_compact(rows)).alias("r"))
    return each.select(((F.col("nth") - 1) * 3 + F.col("r.k")).cast("int").alias("seq"), "model", "r.kind", "r.row_text")


def verdict_lines(rates: DataFrame, counts: DataFrame, model_col: str = "model") -> DataFrame:
    """[SNK8] One fixed-width line a model: published and corrected percent (``---`` where no
    outcome is known), recovered, regressed, one column per verdict; coverage beside it."""
    j = null_safe_join(rates, counts, [model_col], "left").fillna({v: 0 for v in schemas.VERDICTS})

    def percent(c: str) -> F.Column:
        return F.lpad(F.coalesce(F.concat(tx.fmt(c, 1), F.lit("%")), F.lit(schemas.MISSING_CELL)), 11, " ")

    number = [F.lpad(F.col(c).cast("string"), w, " ") for c, w in
              [("recovered", 11), ("regressed", 11), *[(v, 13) for v in schemas.VERDICTS]]]
    line = F.concat(F.rpad(model_col, 22, " "), percent("published"), percent("corrected"), *number)
    share = F.lpad(F.concat(tx.fmt(F.col("coverage") * 100, 1), F.lit("%")), 11, " ")
    return j.select(model_col, line.alias("line"), share.alias("coverage_text"))


def write_reviews(reviews: DataFrame, path: str, key_col: str = "file_key") -> None:
    """[SNK7] Review rows as JSON lines, one output directory per model key (``:`` -> ``_``)."""
    reviews.write.mode("overwrite").partitionBy(key_col).json(path)
