"""Reply forms and text cases of the extractor and triage (FIXTURES.md 3.3)."""

import pytest
from pyspark.sql import functions as F

from runlens.functions import text as tx
from runlens.operators import extract as X
from runlens.operators import triage as TR

FENCE = "```"


def block(body, tag="python"):
    return f"{FENCE}{tag}\n{body}{FENCE}"


FORMS = {
    0: (block("def f7(x):\n  return x\n") + " Example: " + block("print(1)\n", ""), 2, "print(1)\n", "WRONG_BLOCK"),
    1: ("<think>" + block("bad\n") + "</think> " + block("def f7(x):\n  return x\nassert True\n"), 1,
        "def f7(x):\n  return x\nassert True\n", "MODEL_SELF_TEST"),
    2: (" \n ", 0, " \n ", "EMPTY_GENERATION"),
    3: (f"{FENCE}python\ndef g(x):\n  return ", 0, "def g(x):\n  return ", "EMPTY_GENERATION"),
    4: ("just prose here", 0, "just prose here", "EMPTY_GENERATION"),
    5: (f"{FENCE}py\na=1\n{FENCE}\nmid\n{FENCE}\nb\n{FENCE}", 1, "mid\n", "EMPTY_GENERATION"),
    6: (block("def f7(x):\n  return x\n"), 1, "def f7(x):\n  return x\n", "GENUINE_FAILURE"),
}


@pytest.fixture(scope="module")
def triaged(spark):
    rows = [(k, v[0], "f7") for k, v in FORMS.items()]
    df = spark.createDataFrame(rows, "form int, raw string, entry_point string")
    return {r.form: r for r in TR.triage(df).collect()}


@pytest.mark.parametrize("form", sorted(FORMS))
def test_reply_forms(triaged, form):
    _, n_blocks, original, verdict = FORMS[form]
    r = triaged[form]
    assert r.n_blocks == n_blocks
    assert r.original == original
    assert r.verdict == verdict


def test_corrected_extract_strips_self_test(triaged):
    assert triaged[1].corrected == "def f7(x):\n  return x\n"
    assert triaged[0].corrected == "def f7(x):\n  return x\n"
    assert triaged[0].extraction_changed and not triaged[6].extraction_changed


def test_one_python_evaluation_in_plan(spark):
    df = spark.createDataFrame([(FORMS[0][0], "f7")], "raw string, entry_point string")
    plan = TR.triage(df).filter(F.col("verdict") == "WRONG_BLOCK")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("MapInArrow") == 1 and "ArrowEvalPython" not in plan


def _native(spark, text):
    df = spark.createDataFrame([(text,)], "raw string")
    return X.with_blocks(df).collect()[0]


def test_crlf_opener_is_not_a_block(spark):
    assert _native(spark, f"{FENCE}python\r\nx=1\n{FENCE}").n_blocks == 0


def test_unclosed_think_stays(spark):
    r = _native(spark, "<think>" + block("x=1\n"))
    assert r.n_blocks == 1


def test_think_any_case_and_two_spans(spark):
    r = _native(spark, "<Think>a</THINK>" + block("x=1\n") + "<think>" + block("y=2\n") + "</think>")
    assert r.n_blocks == 1 and r.original == "x=1\n"


# --- pure-Python parts of the extraction pass -------------------------------------------

def test_nested_function_and_method_define():
    assert ("f7" in X.code_facts("def outer():\n    def f7():\n        pass\n").names)
    assert ("f7" in X.code_facts("class A:\n    def f7(self):\n        pass\n").names)


def test_class_defines_only_when_parsable():
    assert ("f7" in X.code_facts("class f7:\n    pass\n").names)
    assert not ("f7" in X.code_facts("class f7:\n    pass\n  bad indent\n)").names)


def test_entry_point_with_regex_characters():
    assert not ("f.*" in X.code_facts("def f(x):\n  return (\n").names)
    assert not ("" in X.code_facts("def f.(").names)


def test_truncated_def_found_by_regex():
    assert ("f7" in X.code_facts("def f7(x):").names)


def test_docstring_only_and_asserts_only_unchanged():
    assert X.code_facts('"""doc"""\n').solution == '"""doc"""\n'
    assert X.code_facts("assert 1\nassert 2\n").solution == "assert 1\nassert 2\n"


def test_decorator_kept_and_tests_dropped():
    src = "import os\n@dec\ndef f7():\n    return 1\n\nprint(f7())\nif __name__ == '__main__':\n    f7()\ntry:\n    x = 1\nexcept Exception:\n    pass\n"
    assert X.code_facts(src).solution == "import os\n@dec\ndef f7():\n    return 1\n"


def test_shared_line_emitted_once_and_inline_assert_survives():
    assert X.code_facts("import os; x=1\n").solution == "import os; x=1\n"
    assert X.code_facts("x=1; assert False\n").solution == "x=1; assert False\n"


def test_unparsable_inputs_survive():
    for src in ["x = 1\x00\n", "(" * 3000 + ")" * 3000, "def f(:\n"]:
        facts = X.code_facts(src)
        assert facts.solution == src
        assert not facts.self_test


def test_last_defining_block_wins():
    texts = ["def f7():\n    return 1\n", "def f7():\n    return 2\n", "print(1)\n"]
    assert X.best_candidate([X.code_facts(t) for t in texts], "f7").solution == texts[1]


@pytest.mark.parametrize(
    "texts, entry, best",
    [
        (["def g():\n    pass\n", "x = 1\n"], "f7", 0),  # any definition before none
        (["def g():\n    pass\n", "class H:\n    pass\n", "x = 1\n"], None, 1),
        (["x = 1\n", "y = 2\n"], "f7", 1),
        (["def f7(x:\n", "def g():\n    pass\n"], "f7", 0),  # unparsable def line counts
    ],
)
def test_candidate_ranks(texts, entry, best):
    facts = [X.code_facts(t) for t in texts]
    assert X.best_candidate(facts, entry) is facts[best]


def test_solution_drops_control_flow_and_keeps_annotated_assignments():
    src = "import os\nx: int = 1\ntry:\n    y = 1\nexcept Exception:\n    pass\nfor i in []:\n    pass\nx += 1\nclass A:\n    def f7(self):\n        return 1\n"
    facts = X.code_facts(src)
    assert facts.solution == "import os\nx: int = 1\nclass A:\n    def f7(self):\n        return 1\n"
    assert "f7" in facts.names and not facts.self_test


def test_self_test_kinds():
    assert X.code_facts("assert f(1)\n").self_test
    assert X.code_facts("print(1)\n").self_test
    assert X.code_facts("if True:\n    pass\n").self_test
    assert not X.code_facts("x = f(1)\n").self_test


def test_blank_predicate(spark):
    df = spark.createDataFrame([("  \n",), ("x",), (None,)], "t string")
    assert [r[0] for r in df.select(tx.is_blank("t")).collect()] == [True, False, True]


def test_parser_version_recorded(triaged):
    assert all(r.parser.startswith("python 3.") for r in triaged.values())


def test_job_survives_unparsable_replies(spark):
    bad = [block("x = 1\x00\n"), block("(" * 3000 + ")" * 3000 + "\n"), block("def f7(:\n"), None]
    df = spark.createDataFrame([(i, r, "f7") for i, r in enumerate(bad)], "id int, raw string, entry_point string")
    got = {r.id: r for r in TR.triage(df).collect()}
    assert len(got) == 4
    # unparsable but with a `def f7(` line: defined by the line rule
    assert got[2].corr_defines is True and got[2].verdict == "GENUINE_FAILURE"
    assert got[0].parser and got[1].orig_defines is False
    assert got[3].original == "" and got[3].verdict == "EMPTY_GENERATION"


def test_built_replies_reach_every_branch(spark):
    """The parts of ``built_triage`` lead to every verdict, reason and kind of candidate."""
    from runlens.plans import q_built as Q

    from .conftest import SF_CHECK

    rows = Q.q_built_triage(spark, SF_CHECK).collect()
    assert len({r.reason for r in rows}) == 5 and len({r.verdict for r in rows}) == 4
    assert {(r.orig_defines, r.corr_defines) for r in rows} == {(False, False), (False, True), (True, True)}
    assert {r.n_blocks for r in rows} == {0, 1, 2} and {r.extraction_changed for r in rows} == {True, False}
    for kind in Q.KINDS.values():  # the stated facts are those of the parser
        facts = _facts_of(kind.text.replace("{EP}", "f"))
        assert ("f" in facts.names, facts.any_definition, facts.self_test) == (kind.defines, kind.any_definition, kind.self_test)
        assert facts.solution == kind.solution.replace("{EP}", "f")


def _facts_of(text):
    from runlens.operators.extract import code_facts

    return code_facts(text)
