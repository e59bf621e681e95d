"""Review documents of failing samples: a head with the verdict counts, then one block per
sampled item, in item order.

Every block is composed from columns of its row, and only sampled items (a bounded number per
model) carry their texts; the document of a model is a set of ordered rows that one writer
task puts into one file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens import schemas
from runlens.functions import text as tx
from runlens.operators.runs import null_safe_join
from runlens.operators.triage import task_id_or_default, verdict_counts

MEANINGS = {
    "EMPTY_GENERATION": "nothing to run: a blank reply, or one without the function asked for",
    "WRONG_BLOCK": "the function stands in another block than the one that was run",
    "MODEL_SELF_TEST": "the function was run together with the model's own checks",
    "GENUINE_FAILURE": "the function was run as asked for and did not pass",
}
NOTHING, AGAIN, EMPTY_REPLY = "(nothing)", "(nothing; generate again)", "> *(empty)*"
NOT_RUN, PASSES, FAILS = "not run", "PASS", "STILL FAILS"


def code_block(c: Column, if_empty: str) -> Column:
    code = tx.strip(F.coalesce(c, F.lit("")))
    return F.concat(F.lit("```python\n"), F.when(code == "", F.lit(if_empty)).otherwise(code), F.lit("\n```"))


def rerun_text(now: Column) -> Column:
    return F.when(now.isNull(), F.lit(NOT_RUN)).when(now, F.lit(PASSES)).otherwise(F.lit(FAILS))


def item_block() -> Column:
    """[SNK7] Markdown block of one sampled item.  Columns: task_id, doc_id, verdict, now
    (nullable), entry_point, n_blocks, hidden_test, raw, executed, corrected, extraction_changed."""
    quoted = F.when(tx.is_blank(F.coalesce("raw", F.lit(""))), F.lit(EMPTY_REPLY)).otherwise(tx.quote_lines("raw"))
    parts = [
        F.concat(F.lit("### "), task_id_or_default(), F.lit(": **"), F.col("verdict"), F.lit("**")),
        F.concat(F.lit("Hidden test after correction: **"), rerun_text(F.col("now")), F.lit("**")),
        F.concat(F.lit("- function under test: `"), F.coalesce("entry_point", F.lit("")), F.lit("`\n- fenced blocks in the reply: "), F.col("n_blocks").cast("string")),
        F.concat(F.lit("Hidden test (never shown to the model):\n\n"), code_block(F.col("hidden_test"), NOTHING)),
        F.concat(F.lit("Reply:\n\n"), quoted),
        F.concat(F.lit("Executed by the original run:\n\n"), code_block(F.col("executed"), NOTHING)),
        F.when(F.col("extraction_changed"), F.concat(F.lit("Corrected extraction:\n\n"), code_block(F.col("corrected"), AGAIN))),
        F.lit("- [ ] verdict agreed\n- correction:"),
        F.lit("---"),
    ]
    return F.concat_ws("\n\n", *parts)  # skips the part that does not apply


def head_block(model: str = "model") -> Column:
    """[SNK7] Head of a model's document.  Columns: the model, one count per verdict,
    n_failures, n_sampled, n_known and n_recovered (items re-run, items that pass now)."""
    rows = [F.concat(F.lit(f"| `{v}` | "), F.col(v).cast("string"), F.lit(f" | {MEANINGS[v]} |")) for v in schemas.VERDICTS]
    number = lambda c: F.col(c).cast("string")
    return F.concat_ws(
        "\n\n",
        F.concat(F.lit("# Failure review: `"), F.coalesce(model, F.lit("")), F.lit("`")),
        F.concat_ws("\n", F.lit("| verdict | items | meaning |"), F.lit("|---|---:|---|"), *rows),
        F.concat(F.lit("Failures: **"), number("n_failures"), F.lit("**")),
        F.when(F.col("n_known") > 0, F.concat(F.lit("Pass after correction: **"), number("n_recovered"), F.lit(" of "), number("n_known"), F.lit("** re-run"))),
        F.concat(F.lit("## Sample: "), number("n_sampled"), F.lit(" of "), number("n_failures"), F.lit(" failures")),
    )


def review_documents(triaged: DataFrame, sampled: DataFrame, texts: DataFrame, outcomes: DataFrame) -> DataFrame:
    """[SNK7, SR3] (model, ord, doc_id, block): per model the head (ord 0) and the sampled items'
    blocks by doc_id (ord 1..).

    ``triaged``: all failures (model, doc_id, verdict); ``sampled``: the chosen ones with what
    triage found; ``texts``: model, doc_id, raw, stub, hidden_test, task_id of all samples, of
    which only the sampled are read on; ``outcomes``: model, doc_id, passed."""
    now = outcomes.select("model", "doc_id", F.col("passed").alias("now"))
    status = null_safe_join(triaged.select("model", "doc_id", "verdict"), now, ["model", "doc_id"], "left")
    sums = status.groupBy("model").agg(F.count("now").alias("n_known"), F.count_if("now").alias("n_recovered"))
    sizes = sampled.groupBy("model").agg(F.count(F.lit(1)).alias("n_sampled"))
    head = null_safe_join(null_safe_join(verdict_counts(triaged, ["model"]), sums, ["model"], "left"), sizes, ["model"], "left").fillna({"n_sampled": 0})
    head = head.select("model", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("doc_id"), head_block().alias("block"))
    keys = ["model", "doc_id"]
    found = ["verdict", "entry_point", "n_blocks", "original", "corrected", "extraction_changed"]
    items = null_safe_join(texts.select(*keys, "raw", "stub", "hidden_test", "task_id"), sampled.select(*keys, *found), keys)
    items = null_safe_join(items, now, keys, "left")
    # the run executed the data set's stub and, behind it, what the frozen extractor picked
    items = items.withColumn("executed", F.concat(F.coalesce("stub", F.lit("")), F.coalesce("original", F.lit(""))))
    items = items.select(*keys, F.lit(1).alias("kind"), item_block().alias("block")).select("model", "kind", "doc_id", "block")
    return head.unionByName(items)


def write_review_documents(documents: DataFrame, path: str) -> None:
    """[SNK7] One markdown file per model (``:`` written as ``_``), blocks in order."""
    rows = documents.withColumn("file_key", F.replace(F.coalesce("model", F.lit("none")), F.lit(":"), F.lit("_")))
    rows = rows.repartition("file_key").sortWithinPartitions("file_key", "kind", "doc_id")
    rows.select("file_key", F.col("block").alias("value")).write.mode("overwrite").option("lineSep", "\n\n").partitionBy("file_key").text(path)
