"""Sources, sinks, fleet joins and the stream (FIXTURES.md 3.2, 3.5)."""

import os

import pytest

from pyspark.sql import functions as F

from runlens.operators import fleet as FL
from runlens.session import scratch_path
from runlens.sources import reports as SR
from runlens.streaming import live_cells as LC

CSV = """# REPORT
# Timestamp: 2026-05-21 10:00:00,# Host: box,"# GPU: X (1 MB VRAM), Y (2 MB VRAM)"
Model,Size,Prompt_ID,Prompt_Name,Metric_Type,Run_1,Run_2,Run_3,Run_4,Run_5,Mean,Variance,Std_Dev
 a:7b , 4.1 GB,P1,Fact,Tokens_Per_Sec,1.0,2.0,3.0,0.0,0.0,2.0000,1.0000,1.0000
#odd,x,P2,Prose,Elapsed_Sec,1,1,1,1,1,abc,0,0
Model,Size,Prompt_ID,Prompt_Name,Metric_Type,Run_1,Run_2,Run_3,Run_4,Run_5,Mean,Variance,Std_Dev
b,1 GB,P3,Arith,Tokens_Per_Sec,1,1,1,1,1,1.0000,0.0000,0.0000
"""


def _write(tmp_path, name, text):
    p = os.path.join(tmp_path, name)
    with open(p, "w") as fh:
        fh.write(text)
    return p


def test_csv_header_first_and_meta(spark, tmp_path):
    p = _write(tmp_path, "r.csv", CSV)
    cells, meta = SR.read_cell_csv(spark, p, header="first")
    rows = cells.orderBy("row_ord").collect()
    assert [r.Model for r in rows] == ["a:7b", "#odd", "Model", "b"]
    m = meta.collect()[0]
    assert (m.timestamp, m.host, m.gpu) == ("2026-05-21 10:00:00", "box", "X (1 MB VRAM)")
    typed = SR.typed_cells(cells).filter(F.col("mean").isNotNull())
    assert typed.count() == 2  # the 'abc' and header-text means are skipped


def test_csv_header_last(spark, tmp_path):
    p = _write(tmp_path, "r.csv", CSV)
    cells, meta = SR.read_cell_csv(spark, p, header="last", meta_default="Unknown")
    assert [r.Model for r in cells.collect()] == ["b"]
    assert meta.collect()[0].duration == "Unknown"


def test_keyed_json_both_layouts(spark, tmp_path):
    obj = '{"m:1b|P1": {"gen_tokens_mean": 2.0, "gen_tokens_runs": [1, 3], "prompt_tokens": 5, ' \
          '"thinking_chars_mean": 0.0, "wall_s_mean": 1.5}, "m|P5": {"gen_tokens_mean": 1.0}}'
    p = _write(tmp_path, "t.json", obj.replace(", \"m|P5\"", ",\n \"m|P5\""))
    got = sorted((r.model, r.prompt_id, r.gen_tokens_mean) for r in SR.read_keyed_json(spark, p, whole_file=True).collect())
    assert got == [("m", "P5", 1.0), ("m:1b", "P1", 2.0)]


def test_samples_failfast_and_model_from_path(spark, tmp_path):
    d = os.path.join(tmp_path, "org__m_7b")
    os.makedirs(d)
    _write(d, "s.jsonl", '{"doc_id": 1, "doc": {"entry_point": "f"}, "resps": [["x"]], "pass@1": 0.0}\n\n')
    r = SR.read_samples(spark, os.path.join(tmp_path, "*", "*.jsonl")).collect()[0]
    assert (r.model, r.doc_id) == ("org:m_7b", 1)
    _write(d, "bad.jsonl", "{not json\n")
    try:
        SR.read_samples(spark, os.path.join(tmp_path, "*", "*.jsonl")).collect()
        raise AssertionError("malformed line must fail")
    except Exception as e:  # noqa: BLE001
        assert "AssertionError" not in type(e).__name__


def test_availability_and_size(spark):
    man = spark.createDataFrame([("a:7b", 4_100_000_000), ("b", 1_000_000_000)], "name string, size_bytes long")
    req = spark.createDataFrame([(m,) for m in ["a", "b", "a:7", "c"]], "model string")
    assert sorted(r.model for r in FL.available(req, man).collect()) == ["a", "b"]
    assert sorted(r.model for r in FL.missing(req, man).collect()) == ["a:7", "c"]
    sizes = {r.model: r.size for r in FL.size_lookup(req, man).collect()}
    assert sizes == {"a": "Unknown", "b": "1.0 GB", "a:7": "Unknown", "c": "Unknown"}


def test_availability_is_an_equi_join(spark):
    man = spark.createDataFrame([("a:7b", 1)], "name string, size_bytes long")
    req = spark.createDataFrame([("a",)], "model string")
    plan = FL.available(req, man)._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan


def test_stream_equals_batch_with_duplicates(spark):
    import datetime as dt

    src, out, ckpt = (scratch_path(spark, n) for n in ("t-src", "t-out", "t-ckpt"))
    base = dt.datetime(2024, 1, 1)
    rows = [(i, "m", "P1", base + dt.timedelta(minutes=i), float(i), 1.0) for i in range(1, 7)]
    schema = LC.RUN_SCHEMA
    for chunk in (rows[:2], rows[2:4], rows[4:], rows[4:5]):  # the last file repeats run 5
        spark.createDataFrame(chunk, schema).write.mode("append").parquet(src)
    LC.run_live_cells(spark, src, out, ckpt, files_per_trigger=1)
    got = {r.metric: (r.n, round(r.mean, 4)) for r in LC.published_cells(spark, out).collect()}
    assert got == {"Tokens_Per_Sec": (6, 3.5), "Elapsed_Sec": (6, 1.0)}
    assert len(LC.open_folders(spark, f"{out}/cells")) <= 2  # one batch of runs, one without


def test_samples_both_filtered_layouts(spark, tmp_path):
    from runlens.functions import text as tx

    d = os.path.join(tmp_path, "m")
    os.makedirs(d)
    _write(d, "s.jsonl", '{"doc_id": 1, "resps": [], "filtered_resps": [["a"]], "pass@1": 1.0}\n'
                         '{"doc_id": 2, "resps": [], "filtered_resps": ["b"], "pass@1": 1.0}\n'
                         '{"doc_id": 3, "resps": [["c"]], "pass@1": 0.0}\n')
    r = SR.read_samples(spark, os.path.join(tmp_path, "*", "*.jsonl"))
    got = {x.doc_id: x.leaf for x in r.select("doc_id", tx.first_leaf("resps", "filtered_first", True).alias("leaf")).collect()}
    assert got == {1: "a", 2: "b", 3: "c"}


def test_csv_reader_splits_large_files(spark, tmp_path):
    rows = "\n".join(f"m{i % 3},1 GB,P{i % 12 + 1},x,Tokens_Per_Sec,1,1,1,1,1,{i}.0000,0,0" for i in range(3000))
    text = CSV.split("Model,")[0] + "Model," + CSV.split("Model,")[1].split("\n", 1)[0] + "\n" + rows + "\n"
    p = _write(tmp_path, "big.csv", text)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        cells, meta = SR.read_cell_csv(spark, p)
        assert spark.read.text(p).rdd.getNumPartitions() > 10
        got = [float(r.Mean) for r in cells.orderBy("row_ord").collect()]
        m = meta.collect()[0]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == [float(i) for i in range(3000)]
    assert m.host == "box"
    whole, _ = SR.read_cell_csv(spark, p, whole_file=True)
    assert [float(r.Mean) for r in whole.orderBy("row_ord").collect()] == got


def test_cell_csv_lines_layout(spark):
    from runlens.sinks import reports as SK

    cells = spark.createDataFrame(
        [("r", 1, "m:7b", "4.1 GB", "P1", "Fact", "Tokens_Per_Sec", [1.0, 2.0, 0.0, 0.0, 0.0], 1.5, 0.5, 0.70710678,
          "2026-01-01 00:00:00", "h", "X, Y")],
        "run_set string, row_ord int, model string, size string, prompt_id string, prompt_name string, metric string, "
        "runs array<double>, mean double, variance double, stdev double, timestamp string, host string, gpu string")
    lines = [r.line for r in SK.cell_csv_lines(cells).orderBy("ord").collect()]
    assert lines[0].startswith("#")
    assert lines[1] == '# Timestamp: 2026-01-01 00:00:00,# Host: h,"# GPU: X, Y"'
    assert lines[2].startswith("Model,Size,Prompt_ID")
    assert lines[3] == "m:7b,4.1 GB,P1,Fact,Tokens_Per_Sec,1.0,2.0,0.0,0.0,0.0,1.5000,0.5000,0.7071"


def test_table_rows_missing_marker_and_formatter(spark):
    from runlens.functions import text as tx
    from runlens.sinks import reports as SK

    cells = spark.createDataFrame([("a_b", "tps", "P1", 1.25, 0.05), ("a_b", "tps", "P1", 9.0, 9.0)],
                                  "model string, row_metric string, prompt_id string, mean double, stdev double")
    cells = cells.withColumn("ord", F.monotonically_increasing_id())
    row = SK.table_rows(cells, ["P1", "P2"], fmt_fn=tx.mean_pm_sd, order_col="ord").collect()[0].row_text
    assert row == "\\textbf{\\texttt{a\\_b}} & tps & 9.0 ± 9.0 & --- \\\\"


def test_routing_and_texts(spark):
    from runlens.functions import text as tx

    m = spark.createDataFrame([("b1:x",), ("b3:y",), ("b9:z",)], "name string")
    got = {r.name: r.variant for r in FL.route(m, "name", ["b3"], ["b1"]).collect()}
    assert got == {"b1:x": "chat", "b9:z": "default"}
    r = spark.range(1).select(tx.accelerator_text(F.lit(" GPU A , 12288\nbad\nGPU B,8192\n")).alias("a"),
                              tx.size_text(F.lit(4_150_000_000)).alias("s")).collect()[0]
    assert (r.a, r.s) == ("GPU A (12288 MB VRAM), GPU B (8192 MB VRAM)", "4.2 GB")


def test_overlapping_globs_read_once_and_no_match_fails(spark, tmp_path):
    d = os.path.join(tmp_path, "m")
    os.makedirs(d)
    _write(d, "s.jsonl", '{"doc_id": 1, "resps": [["x"]], "pass@1": 0.0}\n')
    both = [os.path.join(tmp_path, "*", "*.jsonl"), os.path.join(d, "*.jsonl")]
    assert SR.read_samples(spark, both).count() == 1
    try:
        SR.read_samples(spark, os.path.join(tmp_path, "nothing*", "*.jsonl")).count()
        raise AssertionError("no match must fail")
    except Exception as e:  # noqa: BLE001
        assert "AssertionError" not in type(e).__name__


def test_indented_files_and_text_values(spark, tmp_path):
    _write(str(tmp_path), "tokens.json", '{\n  "m|P1": {\n    "gen_tokens_mean": 2.0\n  }\n}\n')
    assert [(r.model, r.prompt_id) for r in SR.read_keyed_json(spark, os.path.join(tmp_path, "tokens.json")).collect()] == [("m", "P1")]
    _write(str(tmp_path), "scores.json", '{\n "results": {"t": {"alias": "t", "acc": 0.5, "err": "N/A"}},\n "config": {"model": "m"}\n}\n')
    got = {r.metric: r.value for r in SR.read_score_files(spark, os.path.join(tmp_path, "scores.json")).collect()}
    assert got == {"alias": None, "acc": 0.5, "err": None}
    _write(str(tmp_path), "bad.json", "[1, 2]\n")
    with pytest.raises(Exception):
        SR.read_keyed_json(spark, os.path.join(tmp_path, "bad.json")).collect()
