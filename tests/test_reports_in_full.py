"""Review documents, publication rows, budgets, planned grids, chunked lists, reports by header name."""

import os
import re

import pytest
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import prompts as PR
from runlens.operators import budgets as BU
from runlens.operators import cells as C
from runlens.operators import runs as R
from runlens.operators import triage as TR
from runlens.session import scratch_path
from runlens.sinks import reports as SK
from runlens.sinks import reviews as RV
from runlens.sources import reports as SR

# ------------------------------------------------------------------ SRC1, SRC2


def write(tmp_path, name, text):
    path = os.path.join(tmp_path, name)
    with open(path, "w", encoding="utf-8") as fh:
        fh.write(text)
    return path


REORDERED = """# Timestamp: 2026-01-02,# Host: one
junk before the header
Mean,Model,Std_Dev,Prompt_ID,Extra,Run_2,"Prompt_Name"
x
 Model,Prompt_ID , Mean,Std_Dev,Metric_Type,Size
" a, b ",P1,1.5,0.25,Tokens_Per_Sec, 4 GB

# a comment is a row,P2,2.5,0.5,Elapsed_Sec,x
# Host: two
"""


@pytest.mark.parametrize("whole", [True, False])
def test_columns_are_found_by_header_name(spark, tmp_path, whole):
    p = write(tmp_path, "r.csv", REORDERED)
    cells, meta = SR.read_cell_csv(spark, p, whole_file=whole)
    got = [(r.Model, r.Size, r.Prompt_ID, r.Metric_Type, r.Mean, r.Std_Dev, r.Run_1) for r in cells.orderBy("row_ord").collect()]
    assert got[:2] == [("a, b", "4 GB", "P1", "Tokens_Per_Sec", "1.5", "0.25", None), ("# a comment is a row", "x", "P2", "Elapsed_Sec", "2.5", "0.5", None)]
    assert [(r.timestamp, r.host) for r in meta.collect()] == [("2026-01-02", "two")]
    other = write(tmp_path, "s.csv", "Mean,Model\n3.0,m\n4.0,n\n")  # no line begins with the model column: the first line it is
    cells, _ = SR.read_cell_csv(spark, [p, other], whole_file=whole)
    assert sorted((r.Model, r.Mean) for r in cells.filter(F.col("file").endswith("s.csv")).collect()) == [("m", "3.0"), ("n", "4.0")]


def test_reports_are_read_in_one_pass(spark, tmp_path):
    p = write(tmp_path, "r.csv", REORDERED)
    df = SR.read_reports(spark, p)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and "Exchange" not in plan and "Join" not in plan
    assert {(r.meta.host, r.meta.timestamp, r.meta.gpu) for r in df.collect()} == {("two", "2026-01-02", "")}


# ------------------------------------------------------------------------ SNK7


def test_review_documents(spark):
    rows = [("m:7b", i, v) for i, v in enumerate(["WRONG_BLOCK"] * 3 + ["EMPTY_GENERATION"])]
    triaged = spark.createDataFrame(rows, "model string, doc_id long, verdict string")
    found = [("m:7b", 2, "WRONG_BLOCK", "f2", 2, "print(1)", "def f2(): pass\n", True), ("m:7b", 0, "WRONG_BLOCK", "f0", 1, " \n", "x", False),
             ("m:7b", 3, "EMPTY_GENERATION", "f3", 0, "", "", True)]
    sampled = spark.createDataFrame(found, "model string, doc_id long, verdict string, entry_point string, n_blocks int, original string, corrected string, extraction_changed boolean")
    texts = spark.createDataFrame([("m:7b", i, ["one\n\ntwo", None, " a ", ""][i], "", ["t()", "", "", None][i], [None, "T/1", "T/2", "T/3"][i]) for i in range(4)],
                                  "model string, doc_id long, raw string, stub string, hidden_test string, task_id string")
    outcomes = spark.createDataFrame([("m:7b", 2, True), ("m:7b", 3, False)], "model string, doc_id long, passed boolean")
    docs = RV.review_documents(triaged, sampled, texts, outcomes)
    path = scratch_path(spark, "t-reviews")
    RV.write_review_documents(docs, path)
    files = [os.path.join(d, f) for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")]
    assert len(files) == 1 and "file_key=m_7b" in files[0].replace("%3A", ":")
    with open(files[0], encoding="utf-8") as fh:
        text = fh.read()
    assert re.findall(r"^### (\S+): \*\*(\w+)", text, re.M) == [("doc_0", "WRONG_BLOCK"), ("T/2", "WRONG_BLOCK"), ("T/3", "EMPTY_GENERATION")]
    assert "| `WRONG_BLOCK` | 3 |" in text and "| `GENUINE_FAILURE` | 0 |" in text
    assert "Failures: **4**" in text and "Pass after correction: **1 of 2** re-run" in text and "## Sample: 3 of 4 failures" in text
    first, second, third = re.split(r"^### ", text, flags=re.M)[1:]
    assert "**not run**" in first and "> one\n>\n> two" in first and "```python\nt()\n```" in first and "Corrected" not in first and "(nothing)" in first
    assert "**PASS**" in second and "> a" in second and "```python\ndef f2(): pass\n```" in second and "fenced blocks in the reply: 2" in second
    assert "**STILL FAILS**" in third and RV.EMPTY_REPLY in third and RV.AGAIN in third
    assert text.count("- [ ] verdict agreed") == 3 and text.count("\n---") == 3


# ------------------------------------------------------------------------ SNK3


def test_publication_rows_keep_first_seen_order(spark):
    rows = [(1, "z_m", "1 GB", "P1", schemas.TPS, 1.0, 0.1), (2, "z_m", "9 GB", "P2", schemas.ELAPSED, 2.0, 0.2), (3, "a", None, "P1", schemas.TPS, 3.0, 0.3),
            (4, "z_m", "9 GB", "P1", schemas.TPS, 5.0, 0.5), (5, "a", "x", "P9", schemas.TPS, 4.0, 0.4)]
    cells = spark.createDataFrame(rows, "row_ord int, model string, size string, prompt_id string, metric string, mean double, stdev double")
    got = [(r.seq, r.kind, r.row_text) for r in SK.publication_rows(cells, ["P2", "P1"]).orderBy("seq").collect()]
    missing = SK.EMPTY_CELL
    assert [k for _, k, _ in got] == ["tps", "elap", "separator", "tps", "elap"]
    assert got[0][2] == rf"    \multirow{{2}}{{*}}{{\textbf{{\texttt{{z\_m}}}}}} & \multirow{{2}}{{*}}{{1 GB}} & {SK.ROW_LABELS['tps']} & {missing} & $5.0 \pm 0.5$ \\"
    assert got[1][2] == rf"    & & {SK.ROW_LABELS['elap']} & $2.0 \pm 0.2$ & {missing} \\"
    assert got[2][2].strip() == r"\midrule" and r"\texttt{a}" in got[3][2]
    assert got[3][2].count(missing) == 1 and got[4][2].count(missing) == 2


# ------------------------------------------------------------------------ TX13


def test_budget_states_and_transitions(spark):
    rows = [("m", "t", 1, 10, 1, 10, 10, " "), ("m", "t", 1, 99, 1, 30, 34, "answer"),  # a larger budget helps
            ("m", "t", 2, 10, 1, 10, 10, None), ("m", "t", 2, 99, 1, 99, 99, ""),  # it does not
            ("m", "t", 3, 10, 1, 0, 4, "x"), ("m", "t", 3, 99, 1, 0, 4, "x"),
            ("m", "t", 4, 10, 1, 0, 0, ""), ("m", "t", 4, 99, 1, 0, 0, "\n"),  # silent, not exhausted
            ("m", "t", 5, 10, 1, 10, 10, ""), ("m", "t", 6, 50, 1, 1, 2, "x"),
            ("m", "t", 1, 10, 0, 3, 5, "an older run")]
    df = spark.createDataFrame(rows, "model string, task string, item int, budget int, run_no int, thinking_tokens int, gen_tokens long, content string")
    r = BU.transitions(df, 10, 99).collect()[0].asDict()
    assert (r["n_items"], r["n_unpaired"]) == (4, 1)
    moves = {k: v for k, v in r.items() if "_to_" in k and v}
    assert moves == {"exhausted_to_answered": 1, "exhausted_to_exhausted": 1, "answered_to_answered": 1, "silent_to_silent": 1}
    a = {r.budget: (r.n, r.answered, r.exhausted, r.silent) for r in BU.audit(df).collect()}
    assert a == {10: (6, 2, 3, 1), 99: (4, 2, 1, 1), 50: (1, 1, 0, 0)}


# -------------------------------------------------------------- AG1, PF2, AG13


def test_planned_cells_without_runs_are_zeros(spark):
    runs = spark.createDataFrame([("a", "P9_T1", 2.0), ("a", "P9_T1", 4.0), ("b", "X", 1.0), (None, "P9_T1", 3.0)], "model string, prompt_id string, value double")
    plan = spark.createDataFrame([("a", "P9_T1"), ("a", "P9_T3"), (None, "P9_T1"), ("c", "P9_T1"), ("c", "P9_T1")], "model string, prompt_id string")
    got = {(r.model, r.prompt_id): (r.n, r.mean, r.variance, r.stdev) for r in C.planned_stats(runs, plan, ["model", "prompt_id"]).collect()}
    assert got == {("a", "P9_T1"): (2, 3.0, 2.0, 1.4142), ("a", "P9_T3"): (0, 0.0, 0.0, 0.0), (None, "P9_T1"): (1, 3.0, 0.0, 0.0),
                   ("c", "P9_T1"): (0, 0.0, 0.0, 0.0), ("b", "X"): (1, 1.0, 0.0, 0.0)}


def test_dialogue_elapsed_has_no_sign_test(spark):
    df = spark.createDataFrame([(1, 10, 1_000_000_000, -5_000_000_000), (2, None, 0, None)], "i int, eval_count long, eval_duration long, total_duration long")
    assert [(r.tps, r.elapsed) for r in R.dialogue_metrics(df).orderBy("i").collect()] == [(10.0, -5.0), (0.0, 0.0)]
    assert [r.elapsed for r in R.response_metrics(df, error_col=None).orderBy("i").collect()] == [0.0, 0.0]


def test_token_list_in_chunks(spark):
    rows = [("a", i, i * 10, i == 230) for i in range(250)] + [(None, i, i, False) for i in range(3)] + [("f", 0, 1, True)]
    df = spark.createDataFrame(rows, "model string, run int, gen_tokens int, failed boolean").repartition(7)
    got = C.token_chunks(df, ["model"], ["run"], F.col("failed"), size=100).collect()
    chunks = {(r.model, r.chunk): list(r.gen_tokens_runs) for r in got}
    assert {k: len(v) for k, v in chunks.items()} == {("a", 0): 100, ("a", 1): 100, ("a", 2): 30, (None, 0): 3}
    assert chunks["a", 0] + chunks["a", 1] + chunks["a", 2] == [i * 10 for i in range(230)]


def test_warm_up_of_a_null_model(spark):
    rows = [(None, 1, False), (None, 2, False), ("a", 1, True), ("a", 2, False), ("b", None, False), ("b", 3, None)]
    df = spark.createDataFrame(rows, "model string, at int, error boolean")
    assert sorted(map(str, R.drop_warmup(df, "model", ["at"]).select("model", "at").collect())) == ["Row(model='b', at=3)", "Row(model=None, at=2)"]


# ------------------------------------------------------ PF8, AG16, SC13-15, TX12


def test_castable_and_agreement(spark):
    df = spark.createDataFrame([("1.5",), ("nan",), ("abc",), (None,), ("",)], "t string")
    assert [(r.v, r.is_nan) for r in C.castable(df, "t", "v").collect()] == [(1.5, False), (None, True)]
    rv = spark.createDataFrame([("m", "A", True), ("m", "A", None), ("m", "B", False)], "model string, verdict string, agreed boolean")
    got = {(r.model, r.verdict): (r.n, r.agree_rate) for r in TR.agreement(rv).collect()}
    assert got == {("m", "A"): (2, 1.0), ("m", "B"): (1, 0.0), ("m", None): (3, 0.5), (None, None): (3, 0.5)}


def test_prompt_parts_and_stops(spark):
    df = spark.createDataFrame([("def f():\n", "f", "def check(c): pass\n", "<think>a\n\nb</think>x```y", None)], "stub string, ep string, test string, raw string, code string")
    r = df.select(PR.render_prompt("Do.", "stub"), PR.check_target("test", "ep"), PR.prediction("stub", "code"), PR.prediction("stub", F.lit(" x")),
                  PR.cut_at_stop("raw", ["```", "zz"]), PR.cut_at_stop("raw", ["zz"]), PR.stop_in_reasoning("raw", ["\n\n"]), PR.stop_in_reasoning("raw", ["```"])).first()
    assert tuple(r) == ("Do.\n```python\ndef f():\n```", "def check(c): pass\n\ncheck(f)", "def f():\n", "def f():\n x", "<think>a\n\nb</think>x", "<think>a\n\nb</think>x```y", True, False)


def test_extraction_keeps_large_ids_beside_nulls(spark):
    big = 2**60
    df = spark.createDataFrame([(big + 1, "```python\ndef f(): pass\n```", "f"), (None, None, "f"), (big + 3, "", None)], "doc_id long, raw string, entry_point string")
    assert sorted(map(str, [r.doc_id for r in TR.triage(df, keep=["doc_id"]).collect()])) == sorted(map(str, [big + 1, None, big + 3]))
