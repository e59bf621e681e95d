"""Catalogue queries: dialogue (A3), fleet (A5), comparisons, report rows, scorers."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import prompts as PR
from runlens.functions import text as tx
from runlens.operators import budgets as BU
from runlens.operators import cells as C
from runlens.operators import compare as CMP
from runlens.operators import fleet as FL
from runlens.operators import model_keys as MK
from runlens.operators import outcomes as OC
from runlens.operators import runs as R
from runlens.operators import scorers as SC
from runlens.operators import triage as TR
from runlens.plans import adapters as A
from runlens.plans import q_runs as QR
from runlens.plans import q_text as QT
from runlens.plans.registry import register
from runlens.sinks import reports as SK


def _w(*ctes: str) -> str:
    return "WITH " + ",\n".join(ctes) + "\n"


WORDS_SQL = ("CASE WHEN regexp_matches(text, '\\S') THEN "
             "len(regexp_split_to_array(regexp_replace(text, '^\\s+|\\s+$', '', 'g'), '\\s+')) ELSE 0 END")


# --- dialogue_context: WN3, SC6 --------------------------------------------------------
@register("dialogue_context", f"""
WITH w AS (SELECT conv_id, turn, role, {WORDS_SQL} AS words FROM conversations)
SELECT conv_id, turn, role, CAST(words AS INTEGER) AS words,
  CAST(coalesce(sum(words) OVER (PARTITION BY conv_id ORDER BY turn
       ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS context_words,
  count(*) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
    AS context_messages
FROM w""")
def q_dialogue_context(spark, sf):
    d = R.dialogue_context(A.turns(spark, sf))
    return d.select("conv_id", "turn", "role", F.col("words").cast("int").alias("words"),
                    "context_words", "context_messages")


# --- dialogue_turn_sample: PF5, WN4 ----------------------------------------------------
@register("dialogue_turn_sample", f"""
WITH u AS (
  SELECT conv_id, turn, {WORDS_SQL} AS words, length(text) % 13 = 0 AS failed,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx
  FROM conversations WHERE role = 'user'),
stops AS (SELECT conv_id, min(idx) AS s FROM u WHERE failed GROUP BY conv_id)
SELECT u.conv_id, 'P9_T' || CAST(idx AS VARCHAR) AS prompt_id, CAST(words AS INTEGER) AS words
FROM u LEFT JOIN stops ON u.conv_id = stops.conv_id
WHERE (stops.s IS NULL OR idx < stops.s) AND idx IN (1, 3, 5)""")
def q_dialogue_turn_sample(spark, sf):
    users = A.turns(spark, sf).filter(F.col("role") == "user")
    # user-turn index within a conversation: a running count (bucketed prefix sum)
    users = R.running_total(users, "conv_id", "turn", F.lit(1).cast("bigint"), "idx", include_current=True)
    ok = R.until_first_failure(users, ["conv_id"], ["turn"], F.length("text") % 13 == 0)
    s = R.sample_turns(ok, turn_col="idx")
    return s.select("conv_id", "prompt_id", tx.word_count("text").cast("int").alias("words"))


# --- available_models / missing_models: JN1, JN2, SO1 ----------------------------------
_MATCH = "m.name = r.model OR starts_with(m.name, r.model || ':')"


@register("available_models", _w(A.MANIFEST_SQL, A.requested_sql()) + f"""
SELECT CAST(ord AS INTEGER) AS ord, model FROM requested r WHERE EXISTS (SELECT 1 FROM manifest m WHERE {_MATCH})""")
def q_available(spark, sf):
    return FL.available(A.requested(spark), A.manifest(spark, sf))


@register("missing_models", _w(A.MANIFEST_SQL, A.requested_sql()) + f"""
SELECT CAST(ord AS INTEGER) AS ord, model FROM requested r
WHERE NOT EXISTS (SELECT 1 FROM manifest m WHERE {_MATCH})""")
def q_missing(spark, sf):
    return FL.missing(A.requested(spark), A.manifest(spark, sf))


# --- size_lookup: JN3, SRC9 ------------------------------------------------------------
@register("size_lookup", _w(A.MANIFEST_SQL, A.requested_sql(),
                            "req AS (SELECT model FROM requested UNION ALL SELECT name AS model FROM manifest)") + """
SELECT req.model, coalesce(printf('%.1f', m.size_bytes / 1e9) || ' GB', 'Unknown') AS size
FROM req LEFT JOIN manifest m ON req.model = m.name""")
def q_size_lookup(spark, sf):
    man = A.manifest(spark, sf)
    req = A.requested(spark).select("model").unionByName(man.select(F.col("name").alias("model")))
    return FL.size_lookup(req, man).select("model", "size")


# --- sweep_routing: SO4 ----------------------------------------------------------------
EXCLUDED = ["b3", "b7"]
REASONING = ["b1", "b2"]


@register("sweep_routing", _w(A.MANIFEST_SQL) + """
SELECT name, CASE WHEN split_part(name, ':', 1) IN ('b1', 'b2') THEN 'chat' ELSE 'default' END AS variant
FROM manifest WHERE split_part(name, ':', 1) NOT IN ('b3', 'b7')""")
def q_sweep_routing(spark, sf):
    return FL.route(A.manifest(spark, sf), "name", EXCLUDED, REASONING).select("name", "variant")


# --- labels_text: SC2, SC3, SC4, SC5, SC8, SC10 ----------------------------------------
@register("labels_text", _w(A.MANIFEST_SQL, """g AS (SELECT *, name || ',' || CAST(size_bytes // 1000000 AS VARCHAR)
  || chr(10) || 'no-fields' AS gpu_raw, size_bytes // 1000000 AS secs FROM manifest)""") + r"""
SELECT name, split_part(name, ':', 1) AS base,
  CASE WHEN strpos(name, ':') > 0 THEN substr(name, strpos(name, ':') + 1) END AS suffix,
  translate(name, ':.', '__') AS file_key,
  '\textbf{\texttt{' || replace(replace(replace(name, '_', '\_'), '&', '\&'), '%', '\%') || '}}' AS tex_label,
  printf('%02d:%02d:%02d', secs // 3600, (secs % 3600) // 60, secs % 60) AS duration,
  array_to_string(list_transform(list_filter(list_transform(string_split(gpu_raw, chr(10)),
      lambda l: string_split(l, ',')), lambda f: len(f) >= 2),
      lambda f: trim(f[1]) || ' (' || trim(f[2]) || ' MB VRAM)'), ', ') AS gpu_text
FROM g""")
def q_labels_text(spark, sf):
    m = A.manifest(spark, sf)
    base, suffix = tx.split_first("name")
    gpu_raw = F.concat(F.col("name"), F.lit(","), (F.col("size_bytes") / 1000000).cast("bigint").cast("string"),
                       F.lit("\nno-fields"))
    label = F.concat(F.lit("\\textbf{\\texttt{"), tx.tex_escape("name"), F.lit("}}"))
    return m.select("name", base.alias("base"), suffix.alias("suffix"), tx.safe_key("name").alias("file_key"),
                    label.alias("tex_label"), tx.hhmmss(F.col("size_bytes") / 1000000).alias("duration"),
                    tx.accelerator_text(gpu_raw).alias("gpu_text"))


# --- run_diff: JN9 ---------------------------------------------------------------------
@register("run_diff", _w(A.samples_sql(), A.OUTCOMES_SQL, """a AS (SELECT model, doc_id, sha256(reply) AS h, pass_at_1 = 1.0 AS p FROM samples),
b AS (SELECT s.model, s.doc_id, sha256(CASE WHEN s.doc_id % 5 = 0 THEN reply || ' ' ELSE reply END) AS h, o.passed AS p
      FROM samples s JOIN outcomes o USING (model, doc_id))""") + """
SELECT model, count(*) FILTER (WHERE b.h IS NOT NULL) AS n_items, count(*) FILTER (WHERE b.h IS NULL) AS only_a,
  0::BIGINT AS only_b, count(*) FILTER (WHERE a.h = b.h) AS identical,
  count(*) FILTER (WHERE NOT a.p AND b.p) AS flipped_up, count(*) FILTER (WHERE a.p AND NOT b.p) AS flipped_down,
  count(*) FILTER (WHERE b.h IS NOT NULL AND (a.p IS NULL OR b.p IS NULL)) AS unknown
FROM a LEFT JOIN b USING (model, doc_id) GROUP BY model""")
def q_run_diff(spark, sf):
    # first run: every sample; second run: the re-executed ones, some replies with a changed end
    s = QT.samples(spark, sf)
    flagged = s.select("model", "doc_id", "raw", OC.from_score("pass_at_1").alias("passed"))
    a = CMP.fingerprinted(flagged, ["model", "doc_id"], "raw", "passed")
    changed = F.when(F.col("doc_id") % 5 == 0, F.concat("raw", F.lit(" "))).otherwise(F.col("raw"))
    b = s.select("model", "doc_id", F.sha2(changed, 256).alias("digest"))
    o = CMP.latest_outcomes(A.outcomes(spark, sf), ["model", "doc_id"])
    return CMP.digest_diff(a, R.null_safe_join(b, o, ["model", "doc_id"]), ["model", "doc_id"], ["model"])


# --- speed_vs_accuracy: JN10 -----------------------------------------------------------
@register("speed_vs_accuracy", _w(A.FLEET_SQL, """sp AS (
  SELECT served, avg(CASE WHEN eval_duration > 0 THEN eval_count / (eval_duration / 1e9) ELSE 0 END) AS mean_tps
  FROM fleet GROUP BY served),
ac AS (SELECT d.source AS model, avg(l.quality) AS accuracy FROM documents d LEFT JOIN labels l USING (doc_id) GROUP BY d.source)""") + """
SELECT sp.served AS speed_model, ac.model AS acc_model, lower(coalesce(ac.model, split_part(served, ':', 1))) AS model_key,
  round(mean_tps, 4) AS mean_tps, round(100 * accuracy, 4) AS accuracy
FROM sp FULL OUTER JOIN ac ON lower(split_part(served, ':', 1)) = lower(ac.model)""")
def q_speed_vs_accuracy(spark, sf):
    runs = R.response_metrics(A.fleet_runs(spark, sf), error_col=None)
    speed = runs.groupBy("served").agg(F.avg("tps").alias("mean_tps"))
    acc = CMP.accuracy(QT.samples(spark, sf)).select("model", "accuracy")
    j = MK.join_on_model(speed, "served", acc, "model")
    return j.select(F.col("served").alias("speed_model"), F.col("model").alias("acc_model"), "model_key",
                    F.round("mean_tps", 4).alias("mean_tps"), F.round("accuracy", 4).alias("accuracy"))


# --- agreement_rollup: AG16 ------------------------------------------------------------
@register("agreement_rollup", _w(*QT.TEXT_SQL, QT.EXPECTED_SQL, """rv AS (
  SELECT x.model, x.verdict, (l.toxic = 0) AS agreed FROM x JOIN labels l ON x.doc_id = l.doc_id
  WHERE x.pass_at_1 = 0.0)""") + """
SELECT model, verdict, count(*) AS n, round(avg(CAST(agreed AS INTEGER)), 4) AS agree_rate
FROM rv GROUP BY ROLLUP (model, verdict)""")
def q_agreement_rollup(spark, sf):
    t = QT.triaged_failures(spark, sf).select("model", "verdict", "doc_id")
    lab = A.table(spark, sf, "labels").select("doc_id", (F.col("toxic") == 0).alias("agreed"))
    return TR.agreement(t.join(lab, "doc_id")).withColumn("agree_rate", F.round("agree_rate", 4))


# --- tex_rows: SNK3, SC1, SC2, SC3 -----------------------------------------------------
TABLE_PROMPTS = ["P1", "P2", "P4", "P5", "P9_T5", "P10", "P11"]


def _tex_cells_sql() -> str:
    parts = [f"coalesce(max(CASE WHEN prompt_id = '{p}' THEN cell END), '---')" for p in TABLE_PROMPTS]
    return " || ' & ' || ".join(parts)


@register("tex_rows", _w(A.METRICS_SQL, """c AS (
  SELECT model, CASE WHEN metric = 'Tokens_Per_Sec' THEN 'tps' ELSE 'elap' END AS row_metric, prompt_id,
    printf('%.1f', mean) || ' ± ' || printf('%.1f', stdev) AS cell FROM cells)""") + r"""
SELECT model, row_metric,
  '\textbf{\texttt{' || replace(replace(replace(model, '_', '\_'), '&', '\&'), '%', '\%') || '}} & '
  || row_metric || ' & ' || """ + _tex_cells_sql() + r""" || ' \\' AS row_text
FROM c GROUP BY model, row_metric""")
def q_tex_rows(spark, sf):
    c = QR.cells(spark, sf).withColumn(
        "row_metric", F.when(F.col("metric") == schemas.TPS, F.lit("tps")).otherwise(F.lit("elap")))
    return SK.table_rows(c, TABLE_PROMPTS, fmt_fn=tx.mean_pm_sd)


# --- numeric_match: BS1 ----------------------------------------------------------------
NUM_RE2 = r"-?\$?[0-9][0-9,]*(?:\.[0-9]+)?"


@register("numeric_match", f"""
WITH d AS (
  SELECT doc_id, text || ' So the answer is $' || CAST((doc_id * 37) % 5000 AS VARCHAR) || '.' AS pred,
    CAST((doc_id * 37) % 5000 + CASE WHEN doc_id % 3 = 0 THEN 1 ELSE 0 END AS VARCHAR) AS gold
  FROM documents),
p AS (SELECT doc_id, gold, regexp_replace(regexp_replace(regexp_extract_all(pred, '{NUM_RE2}')[-1], '[$,]', '', 'g'),
      '\\.$', '') AS pred_number FROM d)
SELECT doc_id, pred_number,
  coalesce(TRY_CAST(pred_number AS DECIMAL(38, 10)) = TRY_CAST(gold AS DECIMAL(38, 10)), false) AS correct
FROM p""")
def q_numeric_match(spark, sf):
    d = A.texts(spark, sf, "documents").select(
        "doc_id",
        F.concat("text", F.lit(" So the answer is $"), ((F.col("doc_id") * 37) % 5000).cast("string"), F.lit(".")).alias("pred"),
        ((F.col("doc_id") * 37) % 5000 + F.when(F.col("doc_id") % 3 == 0, 1).otherwise(0)).cast("string").alias("gold"))
    return d.select("doc_id", SC.last_number("pred").alias("pred_number"), SC.numeric_match("pred", "gold").alias("correct"))


# --- rouge1_acc / bleu_acc: BS2, BS3 ---------------------------------------------------
def _pairs(spark, sf, max_n: int) -> DataFrame:
    """Each document beside one true and one false reference item: the document's tokens are
    made once and meet the references' gram tables; nothing else is joined."""
    bench = A.table(spark, sf, "benchmark").select("item_id", "text")
    n_items = bench.select(F.count(F.lit(1))).scalar()  # scalar subquery, evaluated once
    docs = A.texts(spark, sf, "documents").select("doc_id", SC.tokens("text").alias("toks"))
    pairs = docs.select("doc_id", "toks", F.explode(F.array(
        F.struct((F.col("doc_id") % n_items).alias("item_id"), F.lit(True).alias("is_true")),
        F.struct(((F.col("doc_id") + 1) % n_items).alias("item_id"), F.lit(False).alias("is_true")),
    )).alias("p")).select("doc_id", "toks", "p.item_id", "p.is_true")
    return pairs.join(SC.gram_table(bench, ["item_id"], "text", max_n), "item_id")


def _acc(scored: DataFrame, col: str) -> DataFrame:
    best_t = F.max(F.when(F.col("is_true"), F.col(col)))
    best_f = F.max(F.when(~F.col("is_true"), F.col(col)))
    return scored.groupBy("doc_id").agg(F.round(best_t, 4).alias(f"{col}_true"), F.round(best_f, 4).alias(f"{col}_false"),
                                        (best_t > best_f).alias("acc"))


TOK_SQL = "list_filter(string_split_regex(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')"
PAIRS_SQL = """n AS (SELECT count(*) AS n_items FROM benchmark),
pairs AS (
  SELECT doc_id, doc_id % n_items AS item_id, true AS is_true FROM documents, n
  UNION ALL
  SELECT doc_id, (doc_id + 1) % n_items AS item_id, false AS is_true FROM documents, n)"""


def _grams_sql(src: str, key: str, n: int) -> str:
    """n-gram counts per text; tokens are computed once per row in a subquery."""
    toks = f"(SELECT {key}, {TOK_SQL} AS toks FROM {src})"
    if n == 1:
        g = "unnest(toks)"
    else:
        g = (f"unnest(list_transform(range(1, len(toks) - {n} + 2), "
             f"lambda i: array_to_string(toks[i:i + {n - 1}], ' ')))")
    return f"SELECT {key}, gram, count(*) AS cnt FROM (SELECT {key}, {g} AS gram FROM {toks}) GROUP BY {key}, gram"


@register("rouge1_acc", _w(PAIRS_SQL, f"p AS ({_grams_sql('documents', 'doc_id', 1)})",
                           f"r AS ({_grams_sql('benchmark', 'item_id', 1)})", """
pl AS (SELECT doc_id, sum(cnt) AS plen FROM p GROUP BY doc_id),
rl AS (SELECT item_id, sum(cnt) AS rlen FROM r GROUP BY item_id),
ov AS (SELECT pairs.doc_id, pairs.item_id, sum(least(p.cnt, r.cnt)) AS overlap
       FROM pairs JOIN p ON pairs.doc_id = p.doc_id JOIN r ON r.item_id = pairs.item_id AND r.gram = p.gram
       GROUP BY pairs.doc_id, pairs.item_id),
sc AS (SELECT pairs.*, CAST(coalesce(ov.overlap, 0) AS DOUBLE) AS o, coalesce(pl.plen, 0) AS plen, coalesce(rl.rlen, 0) AS rlen
       FROM pairs LEFT JOIN ov ON pairs.doc_id = ov.doc_id AND pairs.item_id = ov.item_id
       LEFT JOIN pl ON pairs.doc_id = pl.doc_id LEFT JOIN rl ON pairs.item_id = rl.item_id),
f AS (SELECT *, CASE WHEN plen > 0 THEN o / plen ELSE 0 END AS pp, CASE WHEN rlen > 0 THEN o / rlen ELSE 0 END AS rr FROM sc),
g AS (SELECT *, CASE WHEN pp + rr > 0 THEN 2 * pp * rr / (pp + rr) ELSE 0 END AS rouge1 FROM f)""") + """
SELECT doc_id, round(max(rouge1) FILTER (WHERE is_true), 4) AS rouge1_true,
  round(max(rouge1) FILTER (WHERE NOT is_true), 4) AS rouge1_false,
  max(rouge1) FILTER (WHERE is_true) > max(rouge1) FILTER (WHERE NOT is_true) AS acc
FROM g GROUP BY doc_id""")
def q_rouge1(spark, sf):
    return _acc(SC.rouge1_rows(_pairs(spark, sf, 1)), "rouge1")


def _bleu_sql() -> str:
    ctes = [PAIRS_SQL]
    for n in range(1, 5):
        ctes.append(f"p{n} AS ({_grams_sql('documents', 'doc_id', n)})")
        ctes.append(f"r{n} AS ({_grams_sql('benchmark', 'item_id', n)})")
        ctes.append(f"t{n} AS (SELECT doc_id, sum(cnt) AS tot FROM p{n} GROUP BY doc_id)")
        ctes.append(f"""m{n} AS (SELECT pairs.doc_id, pairs.item_id, sum(least(p.cnt, r.cnt)) AS m
  FROM pairs JOIN p{n} p ON pairs.doc_id = p.doc_id JOIN r{n} r ON r.item_id = pairs.item_id AND r.gram = p.gram
  GROUP BY pairs.doc_id, pairs.item_id)""")
    joins = "\n".join(
        f"LEFT JOIN t{n} ON pairs.doc_id = t{n}.doc_id "
        f"LEFT JOIN m{n} ON pairs.doc_id = m{n}.doc_id AND pairs.item_id = m{n}.item_id" for n in range(1, 5))
    cols = ", ".join(f"CAST(coalesce(m{n}.m, 0) AS DOUBLE) AS m{n}, CAST(coalesce(t{n}.tot, 0) AS DOUBLE) AS t{n}"
                     for n in range(1, 5))
    ctes.append(f"""s AS (SELECT pairs.*, {cols},
    len({TOK_SQL.replace('text', 'd.text')}) AS c_len, len({TOK_SQL.replace('text', 'b.text')}) AS r_len
  FROM pairs {joins}
  JOIN documents d ON pairs.doc_id = d.doc_id JOIN benchmark b ON pairs.item_id = b.item_id)""")
    logs = ["CASE WHEN t1 > 0 AND m1 > 0 THEN ln(m1 / t1) END"] + [
        f"ln((m{n} + 1) / (t{n} + 1))" for n in range(2, 5)]
    ctes.append(f"""bl AS (SELECT *,
    CASE WHEN m1 = 0 THEN 0
         ELSE (CASE WHEN c_len >= r_len THEN 1 WHEN c_len > 0 THEN exp(1 - r_len / c_len) ELSE 0 END)
              * exp(({' + '.join(logs)}) / 4.0) END AS bleu FROM s)""")
    return _w(*ctes) + """
SELECT doc_id, round(max(bleu) FILTER (WHERE is_true), 4) AS bleu_true,
  round(max(bleu) FILTER (WHERE NOT is_true), 4) AS bleu_false,
  max(bleu) FILTER (WHERE is_true) > max(bleu) FILTER (WHERE NOT is_true) AS acc
FROM bl GROUP BY doc_id"""


@register("bleu_acc", _bleu_sql())
def q_bleu(spark, sf):
    return _acc(SC.bleu_rows(_pairs(spark, sf, 4)), "bleu")


# --- prompt_build: JN5, SC13, SC14, SC15, SC16 -----------------------------------------
PAYLOAD_WORDS = 2300
INSTRUCTION = "Complete the following Python function. Reply with the code in one fenced block."


@register("prompt_build", f"""
WITH d AS (SELECT doc_id, text, {WORDS_SQL} AS words, doc_id % (SELECT count(*) FROM benchmark) AS item_id FROM documents),
j AS (SELECT d.*, b.text AS item_text, 'def f' || CAST(b.item_id AS VARCHAR) || '(x):' || chr(10)
        || '    ' || repeat(chr(34), 3) || b.text || repeat(chr(34), 3) || chr(10) AS stub
      FROM d JOIN benchmark b ON d.item_id = b.item_id),
k AS (SELECT *, CASE WHEN words = 0 THEN 1 ELSE CAST(ceil({PAYLOAD_WORDS} / words) AS INTEGER) END AS copies FROM j)
SELECT doc_id, item_id,
  md5('{INSTRUCTION}' || chr(10) || '```python' || chr(10) || stub || '```') AS prompt_md5,
  md5('def check(candidate):' || chr(10) || '    assert candidate(1) == 1' || chr(10) || chr(10)
      || 'check(f' || CAST(item_id AS VARCHAR) || ')') AS check_md5,
  md5(stub || '    return x' || chr(10)) AS prediction_md5,
  CAST(copies * words AS INTEGER) AS payload_words,
  md5(repeat(text || chr(10) || chr(10), copies - 1) || text) AS payload_md5
FROM k""")
def q_prompt_build(spark, sf):
    docs = A.texts(spark, sf, "documents").select("doc_id", "text")
    bench = A.table(spark, sf, "benchmark").select("item_id", F.col("text").alias("item_text"))
    n_items = bench.select(F.count(F.lit(1))).scalar()
    # a document's own part is done before the join, so its text is not shuffled
    copies = F.when(F.col("words") == 0, F.lit(1)).otherwise(F.ceil(F.lit(PAYLOAD_WORDS) / F.col("words")).cast("int"))
    d = docs.withColumn("words", tx.word_count("text")).select(
        "doc_id", (F.col("doc_id") % n_items).alias("item_id"), (copies * F.col("words")).cast("int").alias("payload_words"),
        F.md5(tx.repeat_to_words("text", PAYLOAD_WORDS, "words")).alias("payload_md5"))
    # a task document's texts are made once per item
    entry = F.concat(F.lit("f"), F.col("item_id").cast("string"))
    stub = F.concat(F.lit("def "), entry, F.lit("(x):\n    \"\"\""), F.col("item_text"), F.lit("\"\"\"\n"))
    test = F.lit("def check(candidate):\n    assert candidate(1) == 1\n")
    items = bench.withColumn("stub", stub).select(
        "item_id", F.md5(PR.render_prompt(INSTRUCTION, "stub")).alias("prompt_md5"),
        F.md5(PR.check_target(test, entry)).alias("check_md5"), F.md5(PR.prediction("stub", F.lit("    return x\n"))).alias("prediction_md5"))
    return d.join(items, "item_id").select("doc_id", "item_id", "prompt_md5", "check_md5", "prediction_md5", "payload_words", "payload_md5")


# --- prediction_build: SC15 with the extracted code of every sample ---------------------
@register("prediction_build", _w(*QT.TEXT_SQL, QT.EXPECTED_SQL) + """
SELECT doc_id, model,
  md5('def ' || entry_point || '(x):' || chr(10) || '    ' || repeat(chr(34), 3) || 'Return x.' || repeat(chr(34), 3) || chr(10) || corrected) AS prediction_md5,
  md5('def check(candidate):' || chr(10) || '    assert candidate(1) == 1' || chr(10) || chr(10) || 'check(' || entry_point || ')') AS check_md5
FROM x""")
def q_prediction_build(spark, sf):
    s = QT.samples(spark, sf)
    t = TR.triage(s, keep=["model", "doc_id", "entry_point", "stub", "hidden_test"])
    return t.select("doc_id", "model", F.md5(PR.prediction("stub", "corrected")).alias("prediction_md5"),
                    F.md5(PR.check_target("hidden_test", "entry_point")).alias("check_md5"))


# --- scorer_registry: UD1-UD4, BS4 -----------------------------------------------------
BASE_TASK = {"metric": "passed", "args": ["passed"], "name": "score"}


@register("scorer_registry", _w(A.OUTCOMES_SQL) + """
SELECT model, round(avg(CAST(passed AS DOUBLE)), 4) AS pass_at_1, count(*) AS n FROM outcomes
WHERE lang = 'en' GROUP BY model""")
def q_scorer_registry(spark, sf):
    task = {"include": BASE_TASK, "name": "pass_at_1",
            "filters": [lambda df: df.filter(F.col("lang") == "en")]}
    r = SC.score(A.outcomes(spark, sf), task, ["model"])
    return r.select("model", F.round("pass_at_1", 4).alias("pass_at_1"), "n")


# --- stop_cut: TX12 --------------------------------------------------------------------
STOPS = ["```", "\n\n", "Example:"]


def _stop_pos_sql(col: str) -> str:
    cands = ", ".join(f"CASE WHEN strpos({col}, '{s}') > 0 THEN strpos({col}, '{s}') END" for s in STOPS)
    return f"least({cands})"


@register("stop_cut", _w(A.samples_sql(), f"""c AS (SELECT doc_id, reply,
  {_stop_pos_sql('reply')} AS pos,
  array_to_string(regexp_extract_all(reply, '{QT.THINK_RE2}', 0), chr(10)) AS think FROM samples)""") + f"""
SELECT doc_id, CAST(CASE WHEN pos IS NULL THEN length(reply) ELSE pos - 1 END AS BIGINT) AS cut_len,
  coalesce({_stop_pos_sql('think')} IS NOT NULL AND think <> '', false) AS stop_in_reasoning
FROM c""")
def q_stop_cut(spark, sf):
    s = QT.samples(spark, sf)
    return s.select("doc_id", F.length(PR.cut_at_stop("raw", STOPS)).cast("bigint").alias("cut_len"),
                    PR.stop_in_reasoning("raw", STOPS).alias("stop_in_reasoning"))


# --- budget_audit: TX13 ----------------------------------------------------------------
BUDGETS = [4096, 16384]


@register("budget_audit", _w(A.samples_sql(), f"""c AS (SELECT model, doc_id,
  CAST(length(reply) - length(regexp_replace(reply, '{QT.THINK_RE2}', '', 'g')) AS BIGINT) AS thinking_chars,
  regexp_replace(reply, '{QT.THINK_RE2}', '', 'g') AS content FROM samples),
b(budget) AS (VALUES (4096), (16384)),
e AS (SELECT c.model, b.budget, c.thinking_chars,
  CASE WHEN c.thinking_chars + length(c.content) > b.budget THEN '' ELSE c.content END AS content_b
  FROM c, b)""") + """
SELECT model, CAST(budget AS INTEGER) AS budget, count(*) AS n,
  count(*) FILTER (WHERE NOT regexp_matches(content_b, '\\S') AND thinking_chars > 0) AS exhausted
FROM e GROUP BY model, budget""")
def q_budget_audit(spark, sf):
    s = QT.samples(spark, sf)
    content = tx.strip_reasoning("raw")
    c = s.select("model", "doc_id", content.alias("content"),
                 (F.length("raw") - F.length(content)).cast("bigint").alias("thinking_chars"))
    # each generation is judged under both budgets (a literal two-element explode)
    e = c.select("*", F.explode(F.array(*[F.lit(b) for b in BUDGETS])).alias("budget"))
    cb = F.when(F.col("thinking_chars") + F.length("content") > F.col("budget"), F.lit("")).otherwise(F.col("content"))
    e = e.withColumn("content_b", cb)
    return e.groupBy("model", F.col("budget").cast("int").alias("budget")).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(tx.is_blank("content_b") & (F.col("thinking_chars") > 0)).alias("exhausted"))


# --- budget_states / budget_transitions: TX13 on token budgets ---------------------------
BUDGET_SQL = f"""t AS (SELECT source AS model, coalesce(lang, '?') AS task, doc_id AS item, doc_id % 7 = 2 AS blank,
  CASE WHEN doc_id % 7 = 2 THEN 0 ELSE {WORDS_SQL} END AS words FROM documents),
u AS (SELECT t.*, b AS budget, blank OR words >= b AS empty FROM t, (SELECT unnest([4096, 16384]) AS b)),
v AS (SELECT *, CASE WHEN NOT empty THEN 'answered' WHEN words >= budget THEN 'exhausted' ELSE 'silent' END AS state,
  CASE WHEN blank THEN 0 ELSE least(budget, words + 1 + item % 50) END AS gen FROM u)"""


@register("budget_states", _w(BUDGET_SQL) + """
SELECT model, task, CAST(budget AS INTEGER) AS budget, count(*) AS n, count(*) FILTER (WHERE state = 'answered') AS answered,
  count(*) FILTER (WHERE state = 'exhausted') AS exhausted, count(*) FILTER (WHERE state = 'silent') AS silent,
  CAST(sum(gen) AS BIGINT) AS gen_tokens
FROM v GROUP BY model, task, budget""")
def q_budget_states(spark, sf):
    return BU.audit(A.budget_responses(spark, sf))


@register("budget_transitions", _w(BUDGET_SQL) + "SELECT a.model, a.task, count(*) AS n_items, 0::BIGINT AS n_unpaired, " + ", ".join(
    f"count(*) FILTER (WHERE a.state = '{x}' AND b.state = '{y}') AS {x}_to_{y}" for x in BU.STATES for y in BU.STATES) + """
FROM v a JOIN v b ON a.item = b.item AND a.budget < b.budget AND a.model IS NOT DISTINCT FROM b.model GROUP BY a.model, a.task""")
def q_budget_transitions(spark, sf):
    return BU.transitions(A.budget_responses(spark, sf), *A.TOKEN_BUDGETS)


# --- dialogue_cells: AG1 with n = 0, PF2 dialogue form, PF5, WN4 -------------------------
@register("dialogue_cells", """
WITH u AS (
  SELECT 'dialogue-' || CAST(conv_id % 5 AS VARCHAR) AS model, conv_id, length(text) AS size,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS idx FROM conversations WHERE role = 'user'),
ok AS (SELECT * FROM u WHERE idx < coalesce((SELECT min(idx) FROM u f WHERE f.conv_id = u.conv_id AND f.size % 13 = 0), 1000000) AND idx IN (1, 3, 5)),
r AS (
  SELECT model, 'P9_T' || CAST(idx AS VARCHAR) AS prompt_id, 'Tokens_Per_Sec' AS metric, CASE WHEN size > 0 THEN size / (size * 1000000 / 1e9) ELSE 0 END AS value FROM ok
  UNION ALL SELECT model, 'P9_T' || CAST(idx AS VARCHAR), 'Elapsed_Sec', (size - 40) * 7001237 / 1e9 FROM ok),
plan AS (SELECT m.model, p.prompt_id, k.metric FROM (SELECT DISTINCT model FROM u) m, (VALUES ('P9_T1'), ('P9_T3'), ('P9_T5'), ('P9_T7')) p(prompt_id),
  (VALUES ('Tokens_Per_Sec'), ('Elapsed_Sec')) k(metric))
SELECT model, prompt_id, metric, count(value) AS n, round(round(coalesce(avg(value), 0), 9), 4) AS mean,
  round(round(coalesce(var_samp(value), 0), 9), 4) AS variance, round(round(coalesce(stddev_samp(value), 0), 9), 4) AS stdev
FROM plan LEFT JOIN r USING (model, prompt_id, metric) GROUP BY model, prompt_id, metric""")
def q_dialogue_cells(spark, sf):
    users = A.dialogue_turns(spark, sf)
    users = R.running_total(users, "conv_id", "turn", F.lit(1).cast("bigint"), "idx", include_current=True)
    ok = R.until_first_failure(users, ["conv_id"], ["turn"], F.col("failed"))
    rows = R.metric_rows(R.dialogue_metrics(R.sample_turns(ok, turn_col="idx")), ["model", "prompt_id"])
    # the plan holds a turn that is never measured (P9_T7): its cells exist with n = 0
    grid = F.array(*[F.struct(F.lit(f"P9_T{t}").alias("prompt_id"), F.lit(m).alias("metric"))
                     for t in (*schemas.SAMPLED_TURNS, 7) for m in schemas.METRICS])
    plan = users.select("model").distinct().select("model", F.explode(grid).alias("g")).select("model", "g.*")
    return C.planned_stats(rows, plan, ["model", "prompt_id", "metric"])


# --- tex_table: SNK3 in full (first-seen order, size, separators) ------------------------
PUBLISHED = ["P1", "P3", "P9", "P7"]  # P9 has no cells in A4
_LISTED = ", ".join(f"('{p}', {k})" for k, p in enumerate(PUBLISHED))
_NO_CELLS = " & ".join([SK.EMPTY_CELL] * len(PUBLISHED))


@register("tex_table", _w(A.BIG_SQL, r"""pl AS (SELECT *, {'a': l_orderkey, 'b': l_linenumber, 'c': size} AS o FROM big),
c AS (SELECT model, prompt_id, '$' || printf('%.1f', round(round(avg(value), 9), 4)) || ' \pm '
        || printf('%.1f', round(coalesce(stddev_samp(value), 0), 4)) || '$' AS cell FROM big GROUP BY model, prompt_id),
m AS (SELECT model, CAST(row_number() OVER (ORDER BY min(o), model) AS INTEGER) AS nth, arg_min(size, o) AS size FROM pl GROUP BY model)""", f"""
g AS (SELECT m.model, v.p, v.k FROM m, (VALUES {_LISTED}) v(p, k)),
r AS (SELECT g.model, string_agg(coalesce(cell, '{SK.EMPTY_CELL}'), ' & ' ORDER BY k) AS cells
      FROM g LEFT JOIN c ON c.model = g.model AND c.prompt_id = g.p GROUP BY g.model)""") + rf"""
SELECT (nth - 1) * 3 AS seq, model, 'separator' AS kind, '{SK.SEPARATOR}' AS row_text FROM m WHERE nth > 1
UNION ALL
SELECT (nth - 1) * 3 + 1, model, 'tps', '    {SK.SPAN_OPEN}\textbf{{\texttt{{' || model || '}}}}}} & {SK.SPAN_OPEN}' || size || '}} & {SK.ROW_LABELS["tps"]} & ' || cells || ' \\'
FROM m JOIN r USING (model)
UNION ALL
SELECT (nth - 1) * 3 + 2, model, 'elap', '    & & {SK.ROW_LABELS["elap"]} & {_NO_CELLS} \\' FROM m""")
def q_tex_table(spark, sf):
    big = A.big_runs(spark, sf)
    at = F.struct("l_orderkey", "l_linenumber", "size")
    cells = C.cell_stats(big, ["model", "prompt_id"], extra=[F.min(at).alias("row_ord"), F.min_by("size", at).alias("size")])
    return SK.publication_rows(cells.withColumn("metric", F.lit(schemas.TPS)), PUBLISHED)


# --- summary_json: SNK6 -----------------------------------------------------------------
_V = schemas.VERDICTS
SUMMARY_JSON_SQL = _w(*QT.TEXT_SQL, QT.EXPECTED_SQL, *QT.RESCORE_SQL, f"""
v AS (SELECT model, {", ".join(f"count(*) FILTER (WHERE pass_at_1 = 0.0 AND verdict = '{x}') AS c{i}" for i, x in enumerate(_V))}
  FROM x GROUP BY model)""") + f"""
SELECT r.model, CAST(to_json({{'model': r.model, 'n': r.n, 'n_known': r.n_known, 'published_pass@1': round(r.published, 4),
  'corrected_pass@1': round(r.corrected, 4), 'recovered': r.recovered, 'regressed': r.regressed,
  'triage': MAP([{", ".join(f"'{x}'" for x in _V)}], [{", ".join(f"coalesce(v.c{i}, 0)" for i in range(len(_V)))}])}}) AS VARCHAR)
  AS json
FROM rescore r LEFT JOIN v ON r.model IS NOT DISTINCT FROM v.model"""


@register("summary_json", SUMMARY_JSON_SQL)
def q_summary_json(spark, sf):
    s = QT.samples(spark, sf)
    r = CMP.rescore_summary(s, A.outcomes(spark, sf))
    counts = TR.verdict_counts(QT.triaged_failures(spark, sf), ["model"])
    triage_map = F.map_from_arrays(F.array(*[F.lit(v) for v in schemas.VERDICTS]),
                                   F.array(*[F.coalesce(F.col(v), F.lit(0)) for v in schemas.VERDICTS]))
    j = R.null_safe_join(r, counts, ["model"], "left")
    doc = F.struct("model", "n", "n_known", F.round("published", 4).alias("published_pass@1"),
                   F.round("corrected", 4).alias("corrected_pass@1"), "recovered", "regressed",
                   triage_map.alias("triage"))
    return j.select("model", F.to_json(doc, {"ignoreNullFields": "false"}).alias("json"))
