"""Catalogue queries over generation samples (A2), outcomes (A6) and reviews."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import text as tx
from runlens.operators import compare as CMP
from runlens.operators import extract as X
from runlens.operators import outcomes as OC
from runlens.operators import triage as TR
from runlens.plans import adapters as A
from runlens.plans.registry import register
from runlens.session import materialize, scratch_path
from runlens.sinks import reports as SK
from runlens.sinks import reviews as RV

SEED = 42
SAMPLE_N = 12

# DuckDB (RE2) forms of the fixed patterns.
THINK_RE2 = r"(?is)<think>.*?</think>"
FENCE_RE2 = r"(?s)```(?:python)?[ \t]*\n(.*?)```"
DANGLING_RE2 = r"(?s)```(?:python)?[ \t]*\n(.*)"
ANYDEF_RE2 = r"(?m)^\s*(?:async\s+def|def|class)\s+\w+"


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


BLOCKS_SQL = f"""t AS (SELECT *, regexp_replace(reply, '{THINK_RE2}', '', 'g') AS text FROM samples),
b AS (SELECT *, regexp_extract_all(text, '{FENCE_RE2}', 1) AS blocks FROM t),
o AS (SELECT *, CASE WHEN len(blocks) > 0 THEN blocks[-1]
                     WHEN regexp_matches(text, '{DANGLING_RE2}') THEN regexp_extract(text, '{DANGLING_RE2}', 1)
                     ELSE text END AS original FROM b)"""

# Expected results of the Python pass per reply form (see adapters.REPLY_FORMS).
SOLUTION = "def ' || entry_point || '(x):\n    return x\n"
EXPECTED_SQL = f"""x AS (SELECT *,
  CASE form WHEN 0 THEN '{SOLUTION}' WHEN 1 THEN '{SOLUTION}' WHEN 6 THEN '{SOLUTION}'
            WHEN 2 THEN ' \n ' WHEN 5 THEN 'mid\n' ELSE original END AS corrected,
  form IN (1, 6) AS orig_defines, form IN (0, 1, 6) AS corr_defines, form IN (0, 1) AS orig_self_test,
  CASE form WHEN 0 THEN 'WRONG_BLOCK' WHEN 1 THEN 'MODEL_SELF_TEST' WHEN 6 THEN 'GENUINE_FAILURE'
            ELSE 'EMPTY_GENERATION' END AS verdict,
  form IN (0, 1) AS extraction_changed
  FROM o)"""

TEXT_SQL = [A.samples_sql(), BLOCKS_SQL]


def samples(spark: SparkSession, sf: str) -> DataFrame:
    return A.samples(spark, sf).withColumnRenamed("reply", "raw")


def triaged_all(spark: SparkSession, sf: str) -> DataFrame:
    """Every sample through the extraction pass (narrow ride-along columns)."""
    s = samples(spark, sf)
    return TR.triage(s, keep=["model", "doc_id", "form", "task_id", "entry_point", "pass_at_1"])


def triaged_failures(spark: SparkSession, sf: str) -> DataFrame:
    s = TR.failures(samples(spark, sf))
    return TR.triage(s, keep=["model", "doc_id", "form", "task_id", "entry_point", "pass_at_1"])


# --- strip_reasoning: TX1 ------------------------------------------------------------
@register("strip_reasoning", _w(*TEXT_SQL) + """
SELECT doc_id, model, CAST(length(text) AS BIGINT) AS stripped_len, md5(text) AS stripped_md5 FROM t""")
def q_strip_reasoning(spark, sf):
    s = samples(spark, sf).withColumn("text", tx.strip_reasoning("raw"))
    return s.select("doc_id", "model", F.length("text").cast("bigint").alias("stripped_len"),
                    F.md5("text").alias("stripped_md5"))


# --- fence_blocks: TX2, TX4 ----------------------------------------------------------
@register("fence_blocks", _w(*TEXT_SQL) + """
SELECT doc_id, CAST(len(blocks) AS INTEGER) AS n_blocks, md5(array_to_string(blocks, chr(31))) AS blocks_md5 FROM b""")
def q_fence_blocks(spark, sf):
    b = X.with_blocks(samples(spark, sf))
    return b.select("doc_id", F.col("n_blocks").cast("int").alias("n_blocks"),
                    F.md5(F.array_join("blocks", "\u001f")).alias("blocks_md5"))


# --- last_block_extract: TX5 ---------------------------------------------------------
@register("last_block_extract", _w(*TEXT_SQL) + """
SELECT doc_id, CAST(length(original) AS BIGINT) AS original_len, md5(original) AS original_md5 FROM o""")
def q_last_block(spark, sf):
    b = X.with_blocks(samples(spark, sf))
    return b.select("doc_id", F.length("original").cast("bigint").alias("original_len"),
                    F.md5("original").alias("original_md5"))


# --- dangling_block: TX3 -------------------------------------------------------------
@register("dangling_block", _w(*TEXT_SQL) + f"""
SELECT doc_id, regexp_matches(text, '{DANGLING_RE2}') AS has_dangling,
  CASE WHEN regexp_matches(text, '{DANGLING_RE2}')
       THEN CAST(length(regexp_extract(text, '{DANGLING_RE2}', 1)) AS BIGINT) END AS dangling_len
FROM t""")
def q_dangling(spark, sf):
    s = samples(spark, sf).withColumn("text", tx.strip_reasoning("raw"))
    has = tx.has_dangling("text")
    return s.select("doc_id", has.alias("has_dangling"),
                    F.when(has, F.length(tx.dangling_block("text")).cast("bigint")).alias("dangling_len"))


# --- has_definition: TX7 -------------------------------------------------------------
@register("has_definition", _w(*TEXT_SQL) + f"""
SELECT doc_id, regexp_matches(original, '{ANYDEF_RE2}') AS def_in_original,
  regexp_matches(text, '{ANYDEF_RE2}') AS def_in_text FROM o""")
def q_has_definition(spark, sf):
    b = X.with_blocks(samples(spark, sf))
    return b.select("doc_id", tx.has_any_definition("original").alias("def_in_original"),
                    tx.has_any_definition("text").alias("def_in_text"))


# --- corrected_extract: TX8, TX10 ----------------------------------------------------
@register("corrected_extract", _w(*TEXT_SQL, EXPECTED_SQL) + """
SELECT doc_id, model, CAST(length(corrected) AS BIGINT) AS corrected_len, md5(corrected) AS corrected_md5 FROM x""")
def q_corrected(spark, sf):
    t = triaged_all(spark, sf)
    return t.select("doc_id", "model", F.length("corrected").cast("bigint").alias("corrected_len"),
                    F.md5("corrected").alias("corrected_md5"))


# --- self_test_flags: TX6, TX9 -------------------------------------------------------
@register("self_test_flags", _w(*TEXT_SQL, EXPECTED_SQL) + """
SELECT doc_id, orig_defines, corr_defines, orig_self_test FROM x""")
def q_self_test_flags(spark, sf):
    return triaged_all(spark, sf).select("doc_id", "orig_defines", "corr_defines", "orig_self_test")


# --- extraction_changed: PF13 --------------------------------------------------------
@register("extraction_changed", _w(*TEXT_SQL, EXPECTED_SQL) + "SELECT doc_id, extraction_changed FROM x")
def q_extraction_changed(spark, sf):
    return triaged_all(spark, sf).select("doc_id", "extraction_changed")


# --- triage_verdicts: TX11, PF10, PF14 -----------------------------------------------
@register("triage_verdicts", _w(*TEXT_SQL, EXPECTED_SQL) + """
SELECT model, doc_id, coalesce(task_id, 'doc_' || CAST(doc_id AS VARCHAR)) AS task_id, verdict,
  CAST(len(blocks) AS INTEGER) AS n_blocks, extraction_changed
FROM x WHERE pass_at_1 = 0.0""")
def q_triage_verdicts(spark, sf):
    t = triaged_failures(spark, sf)
    return t.select("model", "doc_id", TR.task_id_or_default().alias("task_id"), "verdict",
                    F.col("n_blocks").cast("int").alias("n_blocks"), "extraction_changed")


# --- verdict_summary: AG6, PV7 -------------------------------------------------------
_VCOLS = ",\n  ".join(f"count(*) FILTER (WHERE pass_at_1 = 0.0 AND verdict = '{v}') AS {v}"
                      for v in schemas.VERDICTS)


@register("verdict_summary", _w(*TEXT_SQL, EXPECTED_SQL) + f"""
SELECT model, count(*) FILTER (WHERE pass_at_1 = 0.0) AS n_failures,
  {_VCOLS}
FROM x GROUP BY model""")
def q_verdict_summary(spark, sf):
    t = triaged_failures(spark, sf)
    counts = TR.verdict_counts(t, ["model"])
    models = samples(spark, sf).select("model").distinct()
    zeros = {c: 0 for c in ["n_failures", *schemas.VERDICTS]}
    return models.join(counts, "model", "left").fillna(zeros)


# --- rescoring CTEs: JN6, AG7, AG8, AG9 (labelled rows are counted from the labels) -----
RESCORE_SQL = [A.OUTCOMES_SQL, """scored AS (
  SELECT d.source AS model, d.doc_id, l.quality FROM documents d JOIN labels l USING (doc_id) WHERE l.quality IS NOT NULL)""", """
rates AS (
  SELECT s.model, count(*) AS n_known, 100.0::DOUBLE * avg(quality) AS published,
    100.0::DOUBLE * count(DISTINCT s.doc_id) FILTER (WHERE o.passed) / count(*) AS corrected, count(o.passed) AS n_rerun,
    count(*) FILTER (WHERE quality = 0 AND o.passed) AS recovered,
    count(*) FILTER (WHERE quality = 1 AND o.passed IS DISTINCT FROM true) AS regressed
  FROM scored s LEFT JOIN outcomes o USING (model, doc_id) GROUP BY s.model)""", """
rescore AS (
  SELECT m.model, m.n, coalesce(n_known, 0) AS n_known, coalesce(n_known, 0)::DOUBLE / m.n AS coverage, published, corrected,
    coalesce(n_rerun, 0) AS n_rerun, coalesce(recovered, 0) AS recovered, coalesce(regressed, 0) AS regressed
  FROM (SELECT source AS model, count(*) AS n FROM documents GROUP BY source) m LEFT JOIN rates r ON m.model IS NOT DISTINCT FROM r.model)"""]


# --- verdict_table: SNK8 -------------------------------------------------------------
def _pct_sql(c: str) -> str:
    return f"lpad(coalesce(printf('%.1f', {c}) || '%', '---'), 11, ' ')"


_VTEXT = " || ".join(f"lpad(CAST(count(*) FILTER (WHERE pass_at_1 = 0.0 AND verdict = '{v}') AS VARCHAR), 13, ' ')"
                     for v in schemas.VERDICTS)


@register("verdict_table", _w(*TEXT_SQL, EXPECTED_SQL, *RESCORE_SQL, f"""counted AS (
  SELECT model, {_VTEXT} AS counts FROM x GROUP BY model)""") + f"""
SELECT r.model, rpad(r.model, 22, ' ') || {_pct_sql("published")} || {_pct_sql("corrected")}
  || lpad(CAST(recovered AS VARCHAR), 11, ' ') || lpad(CAST(regressed AS VARCHAR), 11, ' ') || counts AS line,
  lpad(printf('%.1f', 100 * coverage) || '%', 11, ' ') AS coverage_text
FROM rescore r JOIN counted c ON r.model IS NOT DISTINCT FROM c.model""")
def q_verdict_table(spark, sf):
    # rates need every sample but no parsing; only failures go through the Python pass
    rates = CMP.rescore_summary(samples(spark, sf), A.outcomes(spark, sf))
    counts = TR.verdict_counts(triaged_failures(spark, sf), ["model"])
    return SK.verdict_lines(rates, counts)


# --- empty_answers: PF11, PF12, AG12 -------------------------------------------------
@register("empty_answers", _w(A.samples_sql()) + """
SELECT model, count(*) FILTER (WHERE NOT regexp_matches(reply, '\\S')) AS n_empty, count(*) AS n_total
FROM samples GROUP BY model""")
def q_empty_answers(spark, sf):
    return CMP.empty_answers(samples(spark, sf), ["model"])


# --- rescore_summary: JN6, AG7, AG8, AG9 ---------------------------------------------
@register("rescore_summary", _w(*RESCORE_SQL) + """
SELECT model, n, n_known, round(coverage, 4) AS coverage, round(published, 4) AS published, round(corrected, 4) AS corrected,
  n_rerun, recovered, regressed FROM rescore""")
def q_rescore(spark, sf):
    r = CMP.rescore_summary(samples(spark, sf), A.outcomes(spark, sf))
    shown = [F.round(c, 4).alias(c) for c in ("coverage", "published", "corrected")]
    return r.select("model", "n", "n_known", *shown, "n_rerun", "recovered", "regressed")


# --- outcome_transitions: JN6, AG9 (all nine moves of a sample between two scorings) ----
@register("outcome_transitions", _w(A.OUTCOMES_SQL, """j AS (
  SELECT d.source AS model, coalesce(CASE l.quality WHEN 1 THEN 'pass' WHEN 0 THEN 'fail' END, 'unknown') AS was,
    CASE WHEN o.passed THEN 'pass' WHEN NOT o.passed THEN 'fail' ELSE 'unknown' END AS now
  FROM documents d LEFT JOIN labels l USING (doc_id) LEFT JOIN outcomes o USING (doc_id))""") + "SELECT model, " + ", ".join(
    f"count(*) FILTER (WHERE was = '{a}' AND now = '{b}') AS {a}_to_{b}" for a in OC.STATES for b in OC.STATES) + " FROM j GROUP BY model")
def q_outcome_transitions(spark, sf):
    j = CMP.rescored(samples(spark, sf), A.outcomes(spark, sf))
    return j.groupBy("model").agg(*OC.transition_counts(F.col("published"), F.col("rerun")))


# --- pass_at_k: AG10, AG11, BS4 ------------------------------------------------------
PASS_AT_K_KS = [1, 2]
_EST = "\n  UNION ALL\n".join(
    f"""  SELECT {k} AS k, any_pass,
    CASE WHEN n - c < {k} THEN CAST(1 AS DOUBLE) WHEN c = 0 THEN CAST(0 AS DOUBLE)
         ELSE 1 - list_product(list_transform(range(n - c + 1, n + 1), lambda i: 1 - {k}.0 / i)) END AS p
  FROM items WHERE n >= {k}""" for k in PASS_AT_K_KS)
PASS_AT_K_SQL = _w(A.OUTCOMES_SQL, """items AS (
  SELECT doc_id % 164 AS item, count(*) AS n, count(*) FILTER (WHERE passed) AS c, bool_or(passed) AS any_pass
  FROM outcomes GROUP BY item)""", f"est AS (\n{_EST})") + """
SELECT CAST(k AS INTEGER) AS k, count(*) AS n_items, count(*) FILTER (WHERE any_pass) AS items_any_pass,
  round(avg(p), 4) AS pass_at_k
FROM est GROUP BY k"""


def _pass_at_k(spark, sf):
    o = A.outcomes(spark, sf).withColumn("item", F.col("doc_id") % A.N_TASKS)
    r = CMP.pass_at_k(o, "item", PASS_AT_K_KS)
    return r.select(F.col("k").cast("int").alias("k"), "n_items", "items_any_pass",
                    F.round("pass_at_k", 4).alias("pass_at_k"))


register("pass_at_k", PASS_AT_K_SQL)(_pass_at_k)


# --- review_sample: WN6 --------------------------------------------------------------
@register("review_sample", _w(*TEXT_SQL, EXPECTED_SQL, """f AS (SELECT model, verdict, doc_id FROM x WHERE pass_at_1 = 0.0),
cnt AS (SELECT model, verdict, count(*) AS nv, sum(count(*)) OVER (PARTITION BY model) AS total
        FROM f GROUP BY model, verdict),""" + f"""
sh AS (SELECT model, verdict,
  least(nv, greatest(1, CAST(round_even({SAMPLE_N} * nv / greatest(total, 1), 0) AS BIGINT))) AS share FROM cnt),
r AS (SELECT f.*, row_number() OVER (PARTITION BY model, verdict
        ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) AS rk FROM f)""") + """
SELECT r.model, r.verdict, r.doc_id FROM r JOIN sh ON r.model = sh.model AND r.verdict = sh.verdict
WHERE rk <= share""")
def q_review_sample(spark, sf):
    # the triage pass feeds both the verdict counts and the ranking: run it once
    t = materialize(triaged_failures(spark, sf).select("model", "verdict", "doc_id"))
    return TR.review_sample(t, SAMPLE_N, SEED).select("model", "verdict", "doc_id")


# --- failure_table: PF10, PF14, SR3, SR5 ---------------------------------------------
@register("failure_table", _w(A.samples_sql()) + """
SELECT model, doc_id, coalesce(task_id, 'doc_' || CAST(doc_id AS VARCHAR)) AS task_id
FROM samples WHERE pass_at_1 = 0.0""")
def q_failure_table(spark, sf):
    return TR.failures(samples(spark, sf)).select("model", "doc_id", TR.task_id_or_default().alias("task_id"))


# --- review_text: SNK7, SC7, SC5 -----------------------------------------------------
_SPLITLINES_RE2 = r"\r\n|[\n\r\x{0B}\x{0C}\x{1C}\x{1D}\x{1E}\x{85}\x{2028}\x{2029}]"


@register("review_text", _w(A.samples_sql(), f"""q AS (
  SELECT model, doc_id, reply,
    regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS stripped FROM samples WHERE pass_at_1 = 0.0)""") + f"""
SELECT replace(model, ':', '_') AS file_key, doc_id,
  md5(CASE WHEN stripped = '' THEN '> *(empty)*'
      ELSE array_to_string(list_transform(regexp_split_to_array(stripped, '{_SPLITLINES_RE2}'),
                                          lambda ln: CASE WHEN ln = '' THEN '>' ELSE '> ' || ln END), chr(10)) END)
  AS quoted_md5
FROM q""")
def q_review_text(spark, sf):
    f = TR.failures(samples(spark, sf))
    quoted = F.when(tx.is_blank("raw"), F.lit("> *(empty)*")).otherwise(tx.quote_lines("raw"))
    rows = f.select(F.replace(F.col("model"), F.lit(":"), F.lit("_")).alias("file_key"), "doc_id",
                    quoted.alias("quoted"))
    path = scratch_path(spark, "reviews")
    SK.write_reviews(rows, path)
    back = spark.read.schema("doc_id long, quoted string").json(path).withColumn(
        "file_key", F.regexp_extract(F.col("_metadata.file_path"), r"file_key=([^/]*)/", 1))
    return back.select("file_key", "doc_id", F.md5("quoted").alias("quoted_md5"))


# --- review_report: SNK7, SR3 (whole documents: head, then sampled items in order) -------
def _code_sql(c: str, empty: str) -> str:
    trimmed = f"regexp_replace(coalesce({c}, ''), '^\\s+|\\s+$', '', 'g')"
    return f"'```python' || chr(10) || CASE WHEN {trimmed} = '' THEN '{empty}' ELSE {trimmed} END || chr(10) || '```'"


_NL2 = " || chr(10) || chr(10) || "
_ITEM_SQL = _NL2.join([
    "'### ' || coalesce(task_id, 'doc_' || CAST(doc_id AS VARCHAR)) || ': **' || verdict || '**'",
    "'Hidden test after correction: **' || CASE WHEN passed IS NULL THEN 'not run' WHEN passed THEN 'PASS' ELSE 'STILL FAILS' END || '**'",
    "'- function under test: `' || entry_point || '`' || chr(10) || '- fenced blocks in the reply: ' || CAST(len(blocks) AS VARCHAR)",
    "'Hidden test (never shown to the model):' || chr(10) || chr(10) || " + _code_sql("'def check(candidate):' || chr(10) || '    assert candidate(1) == 1'", RV.NOTHING),
    f"""'Reply:' || chr(10) || chr(10) || CASE WHEN stripped = '' THEN '{RV.EMPTY_REPLY}'
      ELSE array_to_string(list_transform(regexp_split_to_array(stripped, '{_SPLITLINES_RE2}'), lambda ln: CASE WHEN ln = '' THEN '>' ELSE '> ' || ln END), chr(10)) END""",
    "'Executed by the original run:' || chr(10) || chr(10) || " + _code_sql("'def ' || entry_point || '(x):' || chr(10) || '    ' || repeat(chr(34), 3) || 'Return x.' || repeat(chr(34), 3) || chr(10) || original", RV.NOTHING),
]) + " || CASE WHEN extraction_changed THEN chr(10) || chr(10) || 'Corrected extraction:' || chr(10) || chr(10) || " + _code_sql("corrected", RV.AGAIN) + " ELSE '' END" + _NL2 + "'- [ ] verdict agreed' || chr(10) || '- correction:'" + _NL2 + "'---'"
_HEAD_SQL = _NL2.join([
    "'# Failure review: `' || model || '`'",
    " || chr(10) || ".join(["'| verdict | items | meaning |'", "'|---|---:|---|'", *[
        f"'| `{v}` | ' || CAST(count(*) FILTER (WHERE verdict = '{v}') AS VARCHAR) || ' | {RV.MEANINGS[v].replace(chr(39), chr(39) * 2)} |'" for v in schemas.VERDICTS]]),
    "'Failures: **' || CAST(count(*) AS VARCHAR) || '**'",
]) + """ || CASE WHEN count(passed) > 0 THEN chr(10) || chr(10) || 'Pass after correction: **' || CAST(count(*) FILTER (WHERE passed) AS VARCHAR) || ' of '
  || CAST(count(passed) AS VARCHAR) || '** re-run' ELSE '' END""" + _NL2 + "'## Sample: ' || CAST(count(*) FILTER (WHERE chosen) AS VARCHAR) || ' of ' || CAST(count(*) AS VARCHAR) || ' failures'"


@register("review_report", _w(*TEXT_SQL, EXPECTED_SQL, A.OUTCOMES_SQL, "f AS (SELECT * FROM x WHERE pass_at_1 = 0.0)", f"""
g AS (SELECT f.*, o.passed, regexp_replace(reply, '^\\s+|\\s+$', '', 'g') AS stripped,
  row_number() OVER (PARTITION BY model, verdict ORDER BY md5('{SEED}:' || CAST(doc_id AS VARCHAR)), doc_id) <=
    least(count(*) OVER (PARTITION BY model, verdict), greatest(1, CAST(round_even({SAMPLE_N} * count(*) OVER (PARTITION BY model, verdict)
      / count(*) OVER (PARTITION BY model), 0) AS BIGINT))) AS chosen
  FROM f LEFT JOIN outcomes o USING (model, doc_id))""") + f"""
SELECT replace(model, ':', '_') AS file_key, 1::BIGINT AS part, md5({_HEAD_SQL}) AS block_md5 FROM g GROUP BY model
UNION ALL
SELECT replace(model, ':', '_'), 1 + row_number() OVER (PARTITION BY model ORDER BY doc_id), md5({_ITEM_SQL}) FROM g WHERE chosen""")
def q_review_report(spark, sf):
    s = samples(spark, sf)
    t = TR.triage(TR.failures(s), keep=["model", "doc_id", "entry_point"])
    t = materialize(t.select("model", "doc_id", "verdict", "entry_point", "n_blocks", "original", "corrected", "extraction_changed"))
    chosen = TR.review_sample(t, SAMPLE_N, SEED)
    documents = RV.review_documents(t, chosen, s, CMP.latest_outcomes(A.outcomes(spark, sf), ["model", "doc_id"]))
    path = scratch_path(spark, "review-documents")
    RV.write_review_documents(documents, path)
    # read the files again and take them apart at the blocks' ends
    files = spark.read.text(f"{path}/file_key=*/part-*", wholetext=True)
    key = F.regexp_extract(F.col("_metadata.file_path"), r"file_key=([^/]*)/", 1)
    blocks = F.split(F.regexp_replace("value", "\n\n$", ""), "(?<=\n---)\n\n|(?<= failures)\n\n(?=### )")
    return files.select(key.alias("file_key"), F.posexplode(blocks).alias("pos", "block")) \
        .select("file_key", (F.col("pos") + 1).cast("bigint").alias("part"), F.md5("block").alias("block_md5"))
