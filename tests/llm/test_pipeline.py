"""The corpus pipeline and the registered queries."""

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
import corpus_pipeline as P
from runlens.llm import queries
from runlens.plans.adapters import TABLES
from tests.conftest import SF_SMALL
from tests.test_catalogue import _digest


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_queries_match_their_oracles(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF_SMALL}/{t}.parquet')")
    df, rel = E.queries()[name](spark, SF_SMALL), con.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(rel.columns)
    assert _digest([tuple(r) for r in df.collect()], df.columns) == _digest(rel.fetchall(), rel.columns)


def test_every_operator_has_one_query():
    assert sorted(int(n.split("_")[0][2:]) for n in queries.QUERIES) == list(range(1, 14))
    assert set(queries.QUERIES) | {"pipeline"} <= set(E.queries())
    assert [n for n, _ in P.STAGES] == ["language", "toxicity", "near duplicates", "mixing", "pieces"]


def test_stages_take_effect(spark, tmp_path):
    rows = [
        (i, " ".join(f"word{(i * 7 + j * j) % 50}" for j in range(30 + i)), "en", "s", "x") for i in range(20)
    ] + [(50, None, "en", "s", "x"), (51, "12 34", "en", None, "x"), (3, " ".join(f"word{(3 * 7 + j * j) % 50}" for j in range(33)), "en", "s", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, __extra string")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    kept = docs
    for _, stage in P.STAGES[:-1]:
        kept = stage(spark, kept, str(tmp_path))
        assert kept.columns == docs.columns
    ids = [r.doc_id for r in kept.collect()]
    assert set(ids) <= set(range(20)) and max(ids.count(i) for i in ids) <= 2
    out = P.run(spark, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(ids) and all(r.restored for r in out)


def test_language_stage_keeps_mixed_and_unlabelled_texts(spark, tmp_path):
    pools = {c: [c + v + c + w for v in "aeiou" for w in "aeiou"] for c in "bkz"}
    rows = [(i, " ".join(pools["bkz"[i % 3]][(i * 7 + j * j) % 25] for j in range(40)), "bkz"[i % 3]) for i in range(60)]
    rows += [(100, " ".join(" ".join(pools[c]) for c in "bkz"), None), (101, "12 34 !", None), (102, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    kept = P.identified(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == set(range(60)) | {100}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    assert {r.doc_id for r in P.identified(spark, unlabelled, str(tmp_path)).collect()} == set(range(60)) | {100}


def test_pipeline_on_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    assert P.run(spark, str(tmp_path)).count() == 0
