"""Multi-party perspective rotation for chat training data.

For every participant of a conversation the dialogue is rendered once with that speaker
as the assistant and all others as named users; context roles (system) stay as they are.
The loss spans are the character ranges the assistant is trained on: its contents with
the end marker.  A rendered text and its spans come from the same pass, so contents that
look like markers cannot shift a span.

A dialogue is rendered in segments of ``SEGMENT`` turns, cut by the exact place of a turn in
the order (turn number, role, text); the segments of a view, in order of their number, put
together are the whole dialogue.  The rule is the same at every size and for any number of
rows with one turn number: places come from counts of equal rows in range partitions, so a
group holds at most ``SEGMENT`` turns however long a conversation is.

A conversation gives rows x participants turns of output: that is the rotation itself, and
its segments are spread over tasks.

Defined results: repeated rows are repeated turns; null turns stand last; a null role is the
speaker ``unknown``; a null text is empty; a null conv_id is a conversation; a conversation
of context roles only has no view.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import materialise
from runlens.operators.runs import null_safe_join

SEGMENT, CONTEXT_ROLES, UNKNOWN = 64, ("system",), "unknown"
END = "<|end|>\n"


def opening(speaker: str, perspective: str, context_roles=CONTEXT_ROLES) -> str:
    if speaker in context_roles:
        return f"<|{speaker}|>\n"
    return "<|assistant|>\n" if speaker == perspective else f"<|user name={speaker}|>\n"


def render(turns: list[tuple[str, str]], perspective: str, context_roles=CONTEXT_ROLES) -> tuple[str, list[tuple[int, int]]]:
    """Text and loss spans of (speaker, content) turns as seen by one participant."""
    out, spans, at = [], [], 0
    for speaker, content in turns:
        head = opening(speaker, perspective, context_roles)
        out += [head, content, END]
        stop = at + len(head) + len(content) + len(END)
        if speaker == perspective:
            spans.append((at + len(head), stop))
        at = stop
    return "".join(out), spans


def placed(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Adds ``lo`` and ``hi``: the places [lo, hi) in their conversation that ``n`` equal rows
    take, for conversations of any size (running counts inside range partitions)."""
    parts = max(2, rows.sparkSession.sparkContext.defaultParallelism, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    tagged = rows.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id())
    tagged = materialise(tagged, "chat-rows")
    sums = tagged.groupBy(*keys, "part").agg(F.sum("n").alias("sum"))
    earlier = Window.partitionBy(*keys).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "part", F.coalesce(F.sum("sum").over(earlier), F.lit(0)).alias("before"))
    inside = Window.partitionBy(*keys, "part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    got = null_safe_join(tagged, sums, [*keys, "part"]).withColumn("hi", F.col("before") + F.sum("n").over(inside))
    return got.withColumn("lo", F.col("hi") - F.col("n")).drop("part", "before")


def segments(conversations: DataFrame, segment: int = SEGMENT) -> DataFrame:
    """conv_id, segment (from 0) and its ordered turns, ``segment`` of them (the last: fewer)."""
    rows = conversations.select(
        "conv_id", F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit(UNKNOWN)).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.withColumn("late", F.col("turn").isNull())
    rows = rows.groupBy("conv_id", "late", "turn", "role", "text").agg(F.count(F.lit(1)).alias("n"))
    rows = placed(rows, ["conv_id"], ["late", "turn", "role", "text"])
    first, last = F.floor(F.col("lo") / segment), F.floor((F.col("hi") - 1) / segment)
    rows = rows.withColumn("segment", F.explode(F.sequence(first, last)))
    lo = F.greatest(F.col("lo"), F.col("segment") * segment)
    n = F.least(F.col("hi"), (F.col("segment") + 1) * segment) - lo
    turn = F.struct(lo.alias("at"), "role", "text", n.cast("int").alias("n"))
    turns = rows.groupBy("conv_id", "segment").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    each = F.transform("turns", lambda t: F.array_repeat(F.struct(t["role"].alias("role"), t["text"].alias("text")), t["n"]))
    return turns.select("conv_id", "segment", F.flatten(each).alias("turns"))


def perspectives(conversations: DataFrame, segment: int = SEGMENT, context_roles=CONTEXT_ROLES) -> DataFrame:
    """conv_id, perspective, segment, n_turns, rendered, spans (array of [start, end)) of
    every view of ``conversations`` (conv_id, turn, role, text)."""
    who = conversations.select("conv_id", F.coalesce("role", F.lit(UNKNOWN)).alias("perspective")).distinct()
    who = who.filter(~F.col("perspective").isin(*context_roles))
    views = null_safe_join(segments(conversations, segment), who, ["conv_id"]).select("conv_id", "perspective", "segment", "turns")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            turns = [[(t["role"], t["text"]) for t in ts] for ts in b.column("turns").to_pylist()]
            done = [render(ts, p, context_roles) for ts, p in zip(turns, b.column("perspective").to_pylist(), strict=True)]
            spans = pa.array([[list(x) for x in s] for _, s in done], pa.list_(pa.list_(pa.int32())))
            columns = [b.column(c) for c in ("conv_id", "perspective", "segment")]
            columns += [pa.array([len(ts) for ts in turns], pa.int64()), pa.array([t for t, _ in done], pa.string()), spans]
            yield pa.RecordBatch.from_arrays(columns, names=["conv_id", "perspective", "segment", "n_turns", "rendered", "spans"])

    kind = views.schema["conv_id"].dataType.simpleString()
    return views.mapInArrow(run, f"conv_id {kind}, perspective string, segment long, n_turns long, rendered string, spans array<array<int>>")


def views(conversations: DataFrame) -> DataFrame:
    """The views with their spans as text (``start:end``, comma-joined)."""
    spans = F.array_join(F.transform("spans", lambda s: F.concat_ws(":", s[0].cast("string"), s[1].cast("string"))), ",")
    return perspectives(conversations).select("conv_id", "perspective", "segment", "n_turns", "rendered", spans.alias("loss_spans"))


ORACLE = rf"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, 'unknown') AS role, coalesce(text, '') AS text,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS LAST, coalesce(role, 'unknown'), coalesce(text, '')) - 1 AS place
  FROM conversations),
p AS (SELECT DISTINCT conv_id, role AS perspective FROM t WHERE role <> 'system'),
v AS (
  SELECT t.conv_id, perspective, place // {SEGMENT} AS segment, place, role,
         CASE WHEN role = 'system' THEN '<|system|>' WHEN role = perspective THEN '<|assistant|>'
              ELSE '<|user name=' || role || '|>' END || chr(10) AS head, text || '<|end|>' || chr(10) AS body
  FROM t JOIN p ON t.conv_id IS NOT DISTINCT FROM p.conv_id),
o AS (SELECT *, sum(length(head) + length(body)) OVER (PARTITION BY conv_id, perspective, segment ORDER BY place) AS stop FROM v)
SELECT conv_id, perspective, CAST(segment AS BIGINT) AS segment, count(*) AS n_turns, string_agg(head || body, '' ORDER BY place) AS rendered,
       coalesce(string_agg(CASE WHEN role = perspective THEN CAST(stop - length(body) AS VARCHAR) || ':' || CAST(stop AS VARCHAR) END, ','
                  ORDER BY place), '') AS loss_spans
FROM o GROUP BY conv_id, perspective, segment
"""
