"""Live cells with late runs (ST1), compaction and partitioned publish (SNK9, SO3)."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from runlens import storage
from runlens.operators import cells as C
from runlens.operators import runs as R
from runlens.session import scratch_path
from runlens.sinks import publish as PB
from runlens.streaming import live_cells as LC

BASE = dt.datetime(2024, 1, 1)


def run(i, hours, model="m", tps=None):
    return (i, model, "P1", BASE + dt.timedelta(hours=hours), float(i if tps is None else tps), 1.0)


def batch_stats(spark, rows):
    df = spark.createDataFrame(list({r[0]: r for r in rows}.values()), LC.RUN_SCHEMA)
    return {tuple(r) for r in shown(C.cell_stats(R.metric_rows(df, ["model", "prompt_id", "run_id", "started_at"]), LC.KEYS))}


def shown(df):
    return df.select(*LC.KEYS, "n", *[F.round(F.round(x, 9), 4).alias(x) for x in ("mean", "variance", "stdev")]).collect()


def test_stream_with_late_runs_equals_batch_and_state_is_bounded(spark):
    rng = random.Random(5)
    src, table, ckpt = (scratch_path(spark, n) for n in ("lt-src", "lt-table", "lt-ckpt"))
    rows = [run(i, i, rng.choice("ab"), rng.random()) for i in range(300)]  # one run an hour
    late = [r for r in rows if r[0] % 17 == 0]
    arrived, largest = [], 0
    for day in range(5):
        part = [r for r in rows if day * 60 <= r[0] < day * 60 + 60 and r not in late]
        part += rng.sample(part, 10)  # copies on time
        if day:
            part += rng.sample(arrived, 5)  # copies of anything before, some beyond the state
        if day in (3, 4):
            part += late[:: 2 if day == 3 else 1]  # late ones, half of them twice
        spark.createDataFrame(part, LC.RUN_SCHEMA).coalesce(2).write.mode("append").parquet(src)
        progress = LC.run_live_cells(spark, src, table, ckpt, files_per_trigger=1, delay="24 hours", compact=3)
        largest = max([largest, *(o["numRowsTotal"] for p in progress for o in p["stateOperators"] if "dedupe" in o["operatorName"])])
        arrived += part
    assert {tuple(r) for r in shown(LC.merged_cells(spark, table))} == batch_stats(spark, rows)
    published = {(r.model, r.metric): r.n for r in LC.published_cells(spark, table).collect()}
    assert sum(n for (_, m), n in published.items() if m == "Elapsed_Sec") < 300
    counted = LC.late_counts(spark, table).agg(F.sum("n_late").alias("a"), F.sum("n_late_runs").alias("b")).first()
    assert counted["a"] >= counted["b"] >= len(late) - 2
    assert 0 < largest <= 110  # a batch and one delay, not the history
    assert len(LC.open_folders(spark, f"{table}/cells")) <= 3


def test_no_late_runs_and_empty_tables(spark):
    src, table, ckpt = (scratch_path(spark, n) for n in ("nl-src", "nl-table", "nl-ckpt"))
    assert LC.merged_cells(spark, table).count() == 0 and LC.late_counts(spark, table).count() == 0
    spark.createDataFrame([run(1, 1), run(2, 2)], LC.RUN_SCHEMA).write.parquet(src)
    LC.run_live_cells(spark, src, table, ckpt)
    assert {tuple(r) for r in shown(LC.merged_cells(spark, table))} == batch_stats(spark, [run(1, 1), run(2, 2)])
    assert LC.late_runs(spark, table).count() == 0


@pytest.mark.parametrize("sizes", [(5, 7), (1, 1), (1, 0), (0, 1), (3, 1)])
def test_combined_statistics_are_those_of_the_union(spark, sizes):
    rng = random.Random(sum(sizes))
    rows = [run(i, i, tps=rng.random() * 100) for i in range(sum(sizes))]
    parts = []
    for part in (rows[: sizes[0]], rows[sizes[0] :]):
        df = spark.createDataFrame(part, LC.RUN_SCHEMA)
        parts.append(LC._stats(R.metric_rows(df, ["model", "prompt_id", "run_id", "started_at"])))
    assert {tuple(r) for r in shown(LC.combine(*parts))} == batch_stats(spark, rows)


def test_compaction_keeps_the_latest_state_and_bounds_reads(spark):
    path = scratch_path(spark, "compact")
    for b in range(11):
        cells = spark.createDataFrame([("m", f"P{b % 3}", "x", b, 1.0, 0.0, 0.0)], "model string, prompt_id string, metric string, n long, mean double, variance double, stdev double")
        LC.publish_cells(spark, cells, path, b, compact=4)
        assert len(LC.open_folders(spark, path)) <= 4
    assert {(r.prompt_id, r.n) for r in LC.read_cells(spark, path).collect()} == {("P0", 9), ("P1", 10), ("P2", 8)}
    # a folder without its marker is not there
    spark.createDataFrame([("m", "P0", "x", 99, 1.0, 0.0, 0.0)], LC.read_cells(spark, path).schema).write.parquet(f"{path}/part=99")
    storage.remove(spark, f"{path}/part=99/_SUCCESS")
    assert max(r.n for r in LC.read_cells(spark, path).collect()) == 10


ROWS = "model string, prompt_id string, metric string, value double, event_id long"


def cell(spark, model, prompt, values):
    return spark.createDataFrame([(model, prompt, "x", float(v), i) for i, v in enumerate(values)], ROWS)


def values(spark, path, **kw):
    out = {}
    for r in PB.read_runs(spark, path, **kw).collect():
        out.setdefault((r.run_set, r.model, r.prompt_id), []).append(r.value)
    return {k: sorted(v) for k, v in out.items()}


def test_publish_shows_finished_cells_only(spark, monkeypatch):
    path = scratch_path(spark, "publish")
    PB.publish(cell(spark, "a", "P1", [1, 2]), path, "r1")
    PB.publish(cell(spark, "a", "P2", [3]), path, "r1")
    # killed between the data and the commit of the next two cells
    with monkeypatch.context() as m:
        m.setattr(PB.F, "current_timestamp", lambda: (_ for _ in ()).throw(RuntimeError("killed")))
        with pytest.raises(RuntimeError):
            PB.publish(cell(spark, "b", "P1", [4]).unionByName(cell(spark, None, "P1", [5])), path, "r1")
    assert values(spark, path) == {("r1", "a", "P1"): [1, 2], ("r1", "a", "P2"): [3]}
    PB.publish(cell(spark, "b", "P1", [6, 7]).unionByName(cell(spark, None, "P1", [8])), path, "r1")  # run again
    PB.publish(cell(spark, "a", "P1", [9]), path, "r1")  # a cell measured anew
    PB.publish(cell(spark, "a", "P1", [10]), path, "r2")
    first = {("r1", "a", "P1"): [9], ("r1", "a", "P2"): [3], ("r1", "b", "P1"): [6, 7], ("r1", None, "P1"): [8]}
    assert values(spark, path, run_sets=["r1"]) == first
    assert values(spark, path) == first | {("r2", "a", "P1"): [10]}
    assert PB.commits(spark, path).count() == 5
