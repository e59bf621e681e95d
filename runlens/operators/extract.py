"""Code extraction from generated replies.

Native (JVM) part: reasoning removal, fenced-block discovery, the frozen
"last block" extractor and the fallback candidate (dangling body or whole text)
are all built-in regex expressions.

Python part: deciding whether a block *defines* a name, whether it carries
top-level self-tests, and cutting those tests out need a Python parser (the
stdlib ``ast``).  That runs once per row in a single ``mapInArrow`` pass over
Arrow batches; every other column rides along or is computed natively.
"""

from __future__ import annotations

import ast
import re
import sys
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from runlens.functions import text as tx

# ---------------------------------------------------------------------------
# Native columns
# ---------------------------------------------------------------------------


def with_blocks(df: DataFrame, raw: str = "raw") -> DataFrame:
    """[TX1-TX5] Add ``text`` (reasoning removed), ``blocks``, ``n_blocks``, ``fallback`` (the
    candidate used when there is no complete block) and ``original`` (frozen
    extractor: last block, else dangling body, else whole text; NULL raw -> '')."""
    text = tx.strip_reasoning(F.coalesce(F.col(raw), F.lit("")))
    return (
        df.withColumn("text", text)
        .withColumn("blocks", tx.fenced_blocks("text"))
        .withColumn("n_blocks", F.size("blocks"))
        .withColumn("fallback", F.when(F.size("blocks") > 0, F.lit(None).cast("string"))
                    .when(tx.has_dangling("text"), tx.dangling_block("text"))
                    .otherwise(F.col("text")))
        .withColumn("original", F.when(F.col(raw).isNull(), F.lit(""))
                    .when(F.size("blocks") > 0, F.element_at("blocks", -1))
                    .otherwise(F.col("fallback")))
    )


# ---------------------------------------------------------------------------
# Python helpers (run inside the Arrow batches)
# ---------------------------------------------------------------------------

# The line patterns that stand in for the parser on code that does not parse.
_DEF_LINE = re.compile(r"(?m)^\s*(?:async\s+)?def\s+(\w+)\s*\(")
_ANY_DEF_LINE = re.compile(r"(?m)^\s*(?:async\s+def|def|class)\s+\w+")
# line breaks as counted by the parser
_LINE_BREAK = re.compile(r"\r\n|\r|\n")

# What a top-level statement is to the extractor, by the parser's names: part of
# the solution, a self-test, or (anything not listed) neither.
_ROLE = dict.fromkeys(
    ("Import", "ImportFrom", "FunctionDef", "AsyncFunctionDef", "ClassDef", "Assign", "AnnAssign"), "solution"
) | dict.fromkeys(("Assert", "If"), "test")


class _Names(ast.NodeVisitor):
    """Collects the names of functions and classes at any depth."""

    def __init__(self) -> None:
        self.found: set[str] = set()

    def _definition(self, node) -> None:
        self.found.add(node.name)
        self.generic_visit(node)

    visit_FunctionDef = visit_AsyncFunctionDef = visit_ClassDef = _definition


class CodeFacts(NamedTuple):
    """Everything the extractor asks of one candidate text, from one parse."""

    names: frozenset[str]
    any_definition: bool
    self_test: bool
    solution: str


def code_facts(src: str) -> CodeFacts:
    """[TX6-TX9] Facts of a candidate.  ``names``: functions and classes anywhere in it (of
    code that does not parse: names of ``def`` lines).  ``self_test``: a top-level assert,
    ``if`` or bare call.  ``solution``: the lines of its top-level imports, definitions with
    decorators, and assignments; a line is taken once however many statements share it;
    the text itself if there are none or it does not parse."""
    any_definition = _ANY_DEF_LINE.search(src) is not None
    try:
        tree = ast.parse(src)
    except Exception:  # SyntaxError, ValueError (NUL), RecursionError, MemoryError
        return CodeFacts(frozenset(_DEF_LINE.findall(src)), any_definition, False, src)
    names = _Names()
    try:
        names.visit(tree)
    except RecursionError:
        return CodeFacts(frozenset(_DEF_LINE.findall(src)), any_definition, False, src)
    lines = _LINE_BREAK.split(src)
    wanted = bytearray(len(lines) + 1)  # 1 where a line belongs to the solution
    self_test = False
    for stmt in tree.body:
        role = _ROLE.get(type(stmt).__name__)
        if role == "solution":
            top = stmt.decorator_list[0].lineno if getattr(stmt, "decorator_list", None) else stmt.lineno
            wanted[top : stmt.end_lineno + 1] = b"\1" * (stmt.end_lineno + 1 - top)
        elif role == "test" or (isinstance(stmt, ast.Expr) and isinstance(stmt.value, ast.Call)):
            self_test = True
    cut = "".join(f"{line}\n" for line, take in zip(lines, wanted[1:], strict=True) if take)
    return CodeFacts(frozenset(names.found), any_definition, self_test, cut if any(wanted) else src)


def best_candidate(facts: Sequence[CodeFacts], entry_point: str | None) -> CodeFacts:
    """[TX10] The candidate of the highest rank, of equal ones the last: defining the entry
    point, else defining anything, else any."""

    def rank(i: int) -> tuple[bool, bool, int]:
        return bool(entry_point) and entry_point in facts[i].names, facts[i].any_definition, i

    return facts[max(range(len(facts)), key=rank)]


def analyse(blocks, fallback, entry_point, original) -> tuple[str, bool, bool, bool]:
    """(corrected extract, original defines ep, corrected defines ep, original has self-tests)."""
    texts = list(blocks) if blocks is not None and len(blocks) > 0 else [fallback or ""]
    known = {t: code_facts(t) for t in texts}
    corrected = best_candidate([known[t] for t in texts], entry_point).solution
    old = known.get(original or "") or code_facts(original or "")
    new = known.get(corrected) or code_facts(corrected)
    return corrected, bool(entry_point) and entry_point in old.names, bool(entry_point) and entry_point in new.names, old.self_test


ANALYSIS_FIELDS = [
    T.StructField("corrected", T.StringType()),
    T.StructField("orig_defines", T.BooleanType()),
    T.StructField("corr_defines", T.BooleanType()),
    T.StructField("orig_self_test", T.BooleanType()),
    # what parses depends on the worker's Python grammar: recorded with every result
    T.StructField("parser", T.StringType()),
]
PARSER = f"python {sys.version_info.major}.{sys.version_info.minor}"


def _original(blocks, fallback) -> str:
    """Frozen extractor from the natively found pieces: last block, else fallback."""
    return blocks[-1] if blocks is not None and len(blocks) > 0 else (fallback or "")


def _batches(it: Iterator[pa.RecordBatch], ep_col: str) -> Iterator[pa.RecordBatch]:
    """Adds the extractor's findings to each batch; the other columns pass as they are."""
    for batch in it:
        rows = []
        for b, f, e in zip(*(batch.column(c).to_pylist() for c in ("blocks", "fallback", ep_col)), strict=True):
            o = _original(b, f)
            rows.append((o, *analyse(b, f, e, o), PARSER))
        ride = [c for c in batch.schema.names if c not in ("blocks", "fallback")]
        found = [pa.array([r[i] for r in rows], pa.bool_() if i in (2, 3, 4) else pa.string()) for i in range(len(ANALYSIS_FIELDS) + 1)]
        yield pa.RecordBatch.from_arrays([batch.column(c) for c in ride] + found, names=[*ride, "original", *[f.name for f in ANALYSIS_FIELDS]])


def analyse_replies(df: DataFrame, raw: str = "raw", entry_point: str = "entry_point",
                    keep: Sequence[str] | None = None) -> DataFrame:
    """[TX6, TX8-TX10] Native block discovery, then one Arrow-batched Python pass.

    Output: ``keep`` columns (default: all input columns except the intermediate
    ``text``) + n_blocks, original, corrected, orig_defines, corr_defines,
    orig_self_test.  Wide columns that are not needed should be left out of
    ``keep`` so they do not travel through the Python worker."""
    b = with_blocks(df, raw)
    if keep is None:
        keep = [c for c in df.columns]
    keep = [c for c in keep if c not in ("n_blocks", "original")]
    if entry_point not in keep:
        keep = [*keep, entry_point]
    # the whole reply travels once (as blocks, or as the fallback when there is no
    # block); ``original`` is derived inside the pass instead of shipped twice
    sel = b.select(*keep, "n_blocks", "blocks", "fallback")
    out_schema = T.StructType([f for f in sel.schema.fields if f.name not in ("blocks", "fallback")]
                              + [T.StructField("original", T.StringType())] + ANALYSIS_FIELDS)
    return sel.mapInArrow(lambda it: _batches(it, entry_point), out_schema)


def extraction_changed() -> F.Column:
    """Stripped original differs from stripped corrected extract."""
    return tx.strip("original") != tx.strip("corrected")
