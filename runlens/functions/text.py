"""Scalar text helpers (``Column -> Column``), all JVM-side.

Regex flags: Python's ``\\s``/``\\w`` are Unicode-aware, Java's are not unless
``(?U)``; Python's multi-line ``^`` breaks only at ``\\n`` while Java's also breaks
at ``\\r`` and U+0085/U+2028/U+2029 unless ``(?d)``.  The patterns below carry
those flags so results follow the Python semantics.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed patterns (Java syntax).
THINK_SPAN = r"(?isu)<think>.*?</think>"
FENCED_BLOCK = r"(?s)```(?:python)?[ \t]*\n(.*?)```"
DANGLING_BLOCK = r"(?s)```(?:python)?[ \t]*\n(.*)"
ANY_DEFINITION = r"(?mdU)^\s*(?:async\s+def|def|class)\s+\w+"
NON_SPACE = r"(?U)\S"
# Python str.splitlines() boundaries
SPLITLINES = r"\r\n|[\n\r\u000B\u000C\u001C\u001D\u001E\u0085\u2028\u2029]"


def col_(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c) -> Column:
    """Python ``str.strip()``: remove leading/trailing Unicode whitespace.

    ``F.trim`` only removes spaces."""
    return F.regexp_replace(col_(c), r"(?U)^\s+|\s+$", "")


def is_blank(c) -> Column:
    """``x.strip() == ''``; NULL counts as blank."""
    c = col_(c)
    return F.coalesce(~c.rlike(NON_SPACE), F.lit(True))


def word_count(c) -> Column:
    """Number of whitespace-separated words (``len(x.split())``), 0 when blank:
    the count of maximal non-space runs, without materialising the words."""
    return F.coalesce(F.regexp_count(col_(c), F.lit(r"(?U)\S+")), F.lit(0))


def strip_reasoning(c) -> Column:
    """Delete every closed ``<think>...</think>`` span (case-insensitive, shortest)."""
    return F.regexp_replace(col_(c), THINK_SPAN, "")


def fenced_blocks(c) -> Column:
    """All complete fenced blocks (body text), in order."""
    return F.regexp_extract_all(col_(c), F.lit(FENCED_BLOCK), 1)


def dangling_block(c) -> Column:
    """Body of the first opener when it has no closing fence: the rest of the text."""
    return F.regexp_extract(col_(c), DANGLING_BLOCK, 1)


def has_dangling(c) -> Column:
    return col_(c).rlike(DANGLING_BLOCK)


def has_any_definition(c) -> Column:
    return F.coalesce(col_(c).rlike(ANY_DEFINITION), F.lit(False))


def first_leaf(resps, filtered=None, filtered_is_leaf: bool = False) -> Column:
    """First string of the nested response arrays, else of the filtered ones, else ''.
    ``filtered_is_leaf``: ``filtered`` already holds the first filtered string."""
    # get() is 0-based and NULL when out of range (try_element_at nested in coalesce
    # falls out of generated code in this Spark version)
    parts = [F.get(F.get(col_(resps), 0), 0)]
    if filtered is not None:
        parts.append(col_(filtered) if filtered_is_leaf else F.get(col_(filtered), 0))
    return F.coalesce(*parts, F.lit(""))


def quote_lines(c) -> Column:
    """Markdown quote: every line of the stripped text prefixed ``> `` (``>`` if empty)."""
    lines = F.split(strip(c), SPLITLINES)
    return F.array_join(
        F.transform(lines, lambda ln: F.when(ln == "", F.lit(">")).otherwise(F.concat(F.lit("> "), ln))),
        "\n",
    )


def tex_escape(c) -> Column:
    """Escape ``_``, ``&`` and ``%`` (one pass each, in that order)."""
    c = col_(c)
    for ch in ["_", "&", "%"]:
        c = F.replace(c, F.lit(ch), F.lit("\\" + ch))
    return c


def safe_key(c) -> Column:
    """File-name key: ``:`` and ``.`` become ``_``."""
    return F.translate(col_(c), ":.", "__")


def split_first(c, sep: str = ":"):
    """Split at the first separator: (base, suffix-or-NULL)."""
    parts = F.split(col_(c), sep, 2)
    return F.element_at(parts, 1), F.try_element_at(parts, F.lit(2))


def fmt(c, places: int) -> Column:
    """``'%.{places}f' % x``: DecimalFormat pattern, half-even on the binary value like
    Python/C, no grouping separators (``F.format_number`` with an int would group)."""
    pattern = "0." + "0" * places if places else "0"
    return F.call_function("format_number", col_(c), F.lit(pattern))


def fmt1(c) -> Column:
    """``'%.1f' % x``."""
    return fmt(c, 1)


def mean_pm_sd(mean, sd) -> Column:
    """Cell text ``mean ± sd``, one decimal each."""
    return F.concat(fmt1(mean), F.lit(" ± "), fmt1(sd))


def hhmmss(seconds) -> Column:
    """Whole seconds as ``HH:MM:SS``; hours are not bounded to two digits."""
    s = F.floor(col_(seconds)).cast("bigint")
    return F.format_string("%02d:%02d:%02d", (s / 3600).cast("bigint"),
                           ((s % 3600) / 60).cast("bigint"), s % 60)


def metric_unit(metric) -> Column:
    return F.when(col_(metric) == "Tokens_Per_Sec", F.lit("t/sec")).otherwise(F.lit("seconds"))


def accelerator_text(c) -> Column:
    """``name,MiB`` lines -> ``name (MiB MB VRAM)`` joined by ``, ``; short lines skipped."""
    lines = F.split(col_(c), r"\n")
    fields = F.transform(lines, lambda ln: F.split(ln, ","))
    kept = F.filter(fields, lambda f: F.size(f) >= 2)
    return F.array_join(
        F.transform(kept, lambda f: F.concat(strip(f[0]), F.lit(" ("), strip(f[1]), F.lit(" MB VRAM)"))),
        ", ",
    )


def size_text(size_bytes) -> Column:
    """Bytes as ``'%.1f GB'`` with 10^9 bytes per GB."""
    return F.concat(fmt(col_(size_bytes) / F.lit(1e9), 1), F.lit(" GB"))


def repeat_to_words(text, min_words: int, words=None) -> Column:
    """Repeat the paragraph (blank-line separated) until it holds at least ``min_words``
    words (``words``: an already computed word count of ``text``)."""
    t = col_(text)
    n = word_count(t) if words is None else col_(words)
    copies = F.when(n == 0, F.lit(1)).otherwise(F.ceil(F.lit(min_words) / n).cast("int"))
    return F.array_join(F.array_repeat(t, copies), "\n\n")
