"""Prompt, check and prediction texts of code tasks, and cutting at stop sequences."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from runlens.functions.text import THINK_SPAN, col_


def render_prompt(instruction: str, stub) -> Column:
    """[SC13] The instruction and the function's stub in a fenced block."""
    return F.concat(F.lit(f"{instruction}\n```python\n"), col_(stub), F.lit("```"))


def check_target(test, entry_point) -> Column:
    """[SC14] The hidden test with the call that runs it on the entry point."""
    return F.concat(col_(test), F.lit("\ncheck("), col_(entry_point), F.lit(")"))


def prediction(stub, code) -> Column:
    """[SC15] What is executed: the stub and, behind it, the extracted code."""
    return F.concat(col_(stub), F.coalesce(col_(code), F.lit("")))


def first_stop(c, stops: Sequence[str]) -> Column:
    """Position (from 1) of the earliest stop sequence; null when there is none."""
    text = col_(c)
    at = [F.when(F.instr(text, s) > 0, F.instr(text, s)) for s in stops]
    return F.least(*at) if len(at) > 1 else at[0]


def cut_at_stop(c, stops: Sequence[str]) -> Column:
    """[TX12] The text before the earliest stop sequence."""
    at = first_stop(c, stops)
    return F.when(at.isNull(), col_(c)).otherwise(F.substring(col_(c), F.lit(1), at - 1))


def stop_in_reasoning(c, stops: Sequence[str]) -> Column:
    """[TX12] Whether a stop sequence stands inside a reasoning span."""
    spans = F.regexp_extract_all(col_(c), F.lit(THINK_SPAN), F.lit(0))
    return F.coalesce(F.exists(spans, lambda s: first_stop(s, stops).isNotNull()), F.lit(False))
