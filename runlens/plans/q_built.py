"""Triage of replies that are built from parts with known facts.

Every document gives one reply: optional reasoning, up to two code blocks of the kinds below,
prose (the document's text) and an optional opener that is never closed.  What each kind of
block is (does it define the function asked for, anything at all, does it test itself, which
lines are its solution) is stated once per kind; the expected result of a reply follows from
the rules over its parts, so the oracle knows no typed answer for any combination.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from runlens.operators import triage as TR
from runlens.plans import adapters as A
from runlens.plans.registry import register


class Kind(NamedTuple):
    """A code block: its text ({EP}: the function asked for), its solution, its facts."""

    text: str
    solution: str
    defines: bool
    any_definition: bool
    self_test: bool


_PLAIN = "def {EP}(x):\n    return x\n"
_GUARDED = "@cache\ndef {EP}(x):\n    def inner():\n        pass\n    return x\n"
KINDS = {
    "solution": Kind("import os\n" + _PLAIN, "import os\n" + _PLAIN, True, True, False),
    "checked": Kind(_PLAIN + "assert {EP}(1) == 1\n", _PLAIN, True, True, True),
    "helper": Kind("def helper(x):\n    return x\n", "def helper(x):\n    return x\n", False, True, False),
    "example": Kind("print({EP}(1))\n", "print({EP}(1))\n", False, False, True),
    "broken": Kind("def {EP}(x):\n    return ((x\n", "def {EP}(x):\n    return ((x\n", True, True, False),
    "blank": Kind("\n", "\n", False, False, False),
    "guarded": Kind(_GUARDED + "if True:\n    {EP}(2)\n", _GUARDED, True, True, True),
    "method": Kind("class Box:\n    def {EP}(self):\n        pass\n", "class Box:\n    def {EP}(self):\n        pass\n", True, True, False),
    "bound": Kind("{EP} = lambda x: x\n", "{EP} = lambda x: x\n", False, False, False),
}
NAMES = [*KINDS, "none"]
#: What stands in the last place: nothing, an opener with code that is never closed, nothing at all in the whole reply.
TAILS = ["plain", "open", "empty"]
THINKING = ["", "<think>\n```python\ndef {EP}(): pass\n```\n</think>", "<think>"]
OPEN_KIND = "checked"


def _pick(column, values):
    out = F.lit(values[-1])
    for i, v in enumerate(values[:-1]):
        out = F.when(column == i, F.lit(v)).otherwise(out)
    return out


def built_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, entry_point (null for doc_id % 50 = 7), raw."""
    n = len(NAMES)
    d = A.texts(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    i = F.col("doc_id")
    ep = F.concat(F.lit("f"), (i % 164).cast("string"))

    def block(k):
        name, text = _pick(k, NAMES), _pick(k, [KINDS[x].text if x in KINDS else "" for x in NAMES])
        return F.when(name == "none", F.lit("")).otherwise(F.concat(F.lit("```python\n"), text, F.lit("```\n")))

    div = lambda k: F.floor(i / k)
    tail = div(n * n) % len(TAILS)
    thinking = _pick((div(n * n) + div(7)) % len(THINKING), THINKING)
    opened = F.when(tail == 1, F.lit("\n```python\n" + KINDS[OPEN_KIND].text)).otherwise(F.lit(""))
    no_blocks = (i % n == n - 1) & (div(n) % n == n - 1)
    raw = F.concat(thinking, F.lit("?? "), F.col("text"), F.lit("\n"), block(i % n), F.lit("and\n"), block(div(n) % n), opened)
    raw = F.when((tail == 2) & no_blocks, F.lit(" \n\t")).otherwise(raw)
    return d.select("doc_id", F.when(i % 50 != 7, ep).alias("entry_point"), F.replace(raw, F.lit("{EP}"), ep).alias("raw"))


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _kinds_sql() -> str:
    rows = ", ".join(f"({i}, {_lit(k.text)}, {_lit(k.solution)}, {k.defines}, {k.any_definition}, {k.self_test})" for i, k in enumerate(KINDS.values()))
    return f"kind(k, body, sol, defines, any_def, self_test) AS (VALUES {rows})"


def _oracle() -> str:
    n, m = len(NAMES), len(NAMES) * len(NAMES)
    opened = list(KINDS).index(OPEN_KIND)
    bare = "concat(CASE ((doc_id // {m} + doc_id // 7) % 3) WHEN 2 THEN '<think>' ELSE '' END, '?? ', text, chr(10), 'and', chr(10))".format(m=m)
    return f"""
WITH {_kinds_sql()},
d AS (SELECT doc_id, coalesce(text, '') AS text, 'f' || CAST(doc_id % 164 AS VARCHAR) AS ep, doc_id % 50 <> 7 AS asked,
  doc_id % {n} AS k1, doc_id // {n} % {n} AS k2, doc_id // {m} % 3 AS tail FROM documents),
b AS (SELECT doc_id, pos, kind.* FROM (SELECT doc_id, 1 AS pos, k1 AS k FROM d UNION ALL SELECT doc_id, 2, k2 FROM d) JOIN kind USING (k)),
picked AS (SELECT doc_id, count(*) AS n_blocks, arg_max(k, pos) AS last_k FROM b GROUP BY doc_id),
best AS (SELECT d.doc_id, arg_max(k, CASE WHEN asked AND defines THEN 100 WHEN any_def THEN 10 ELSE 0 END + pos) AS best_k FROM b JOIN d USING (doc_id) GROUP BY d.doc_id),
f AS (
  SELECT d.*, coalesce(n_blocks, 0) AS n_blocks, coalesce(last_k, CASE WHEN tail = 1 THEN {opened} END) AS o_k,
    coalesce(best_k, CASE WHEN tail = 1 THEN {opened} END) AS c_k, n_blocks IS NULL AND tail = 2 AS blank
  FROM d LEFT JOIN picked USING (doc_id) LEFT JOIN best USING (doc_id)),
r AS (
  SELECT doc_id, n_blocks, blank,
    CASE WHEN blank THEN ' ' || chr(10) || chr(9) WHEN o_k IS NULL THEN {bare} ELSE replace(o.body, '{{EP}}', ep) END AS original,
    CASE WHEN blank THEN ' ' || chr(10) || chr(9) WHEN c_k IS NULL THEN {bare} ELSE replace(c.sol, '{{EP}}', ep) END AS corrected,
    coalesce(asked AND o.defines, false) AS od, coalesce(asked AND c.defines, false) AS cd, coalesce(o.self_test, false) AS st
  FROM f LEFT JOIN kind o ON o.k = o_k LEFT JOIN kind c ON c.k = c_k)
SELECT doc_id, CAST(n_blocks AS INTEGER) AS n_blocks, md5(original) AS original_md5, md5(corrected) AS corrected_md5,
  od AS orig_defines, cd AS corr_defines, st AS orig_self_test,
  CASE WHEN blank THEN 'EMPTY_GENERATION' WHEN cd AND NOT od THEN 'WRONG_BLOCK' WHEN od AND st THEN 'MODEL_SELF_TEST'
       WHEN od THEN 'GENUINE_FAILURE' ELSE 'EMPTY_GENERATION' END AS verdict,
  CASE WHEN blank THEN 'blank reply' WHEN cd AND NOT od THEN 'solution in another block' WHEN od AND st THEN 'self-tests before hidden test'
       WHEN od THEN 'extract intact' ELSE 'no entry point in extract' END AS reason,
  regexp_replace(original, '^\\s+|\\s+$', '', 'g') <> regexp_replace(corrected, '^\\s+|\\s+$', '', 'g') AS extraction_changed
FROM r"""


# --- built_triage: TX4-TX11, PF13 over replies built from parts ------------------------------
@register("built_triage", _oracle())
def q_built_triage(spark, sf):
    t = TR.triage(built_samples(spark, sf), keep=["doc_id", "entry_point"])
    return t.select("doc_id", F.col("n_blocks").cast("int").alias("n_blocks"), F.md5("original").alias("original_md5"),
                    F.md5("corrected").alias("corrected_md5"), "orig_defines", "corr_defines", "orig_self_test",
                    "verdict", "reason", "extraction_changed")
