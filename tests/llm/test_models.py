"""Held-out accuracy of the trained models, and the pipeline from end to end."""

import duckdb
import pytest

from loomgraph.llm import queries

FOLDER = "/root/testdata/sf0.01"


def test_language_held_out(spark):
    rows = queries.op7_language_id(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/documents.parquet").select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert len(rows) > 150 and sum(r["lang"] == r["lang_pred"] for r in rows) / len(rows) > 0.97


def test_quality_held_out(spark):
    rows = queries.op5_quality(spark, FOLDER).join(spark.read.parquet(f"{FOLDER}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 40 and sum(r["quality"] == r["predicted"] for r in rows) / len(rows) > 0.93


@pytest.mark.parametrize("name", ["op6_url_filter", "op9_line_dedup"])
def test_sql(spark, data, name):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.queries()[name](spark, data)
    got = con.execute(queries.oracle_sql()[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(map(repr, got.fetchall())) == sorted(repr(tuple(r[n] for n in names)) for r in df.collect())


def test_pipeline(spark, data):
    """Stage by stage: what each drops, and that what is left is packed whole."""
    import corpus_pipeline

    from .test_brute_force import components, shingles

    docs = spark.read.parquet(f"{data}/documents.parquet")
    (_, language), (_, lines), (_, near), (_, clean), _ = corpus_pipeline.STAGES
    a = language(spark, docs, data).cache()
    assert docs.count() - a.count() <= 3
    b = lines(spark, a, data).cache()
    text = {r["doc_id"]: r["text"] for r in b.collect()}
    assert all(r["n_chars"] == len(r["text"]) for r in b.collect())
    c = near(spark, b, data).cache()
    want = components({k: shingles(t) for k, t in text.items()})
    assert {r["doc_id"] for r in c.collect()} == {k for k, v in want.items() if k == v}
    d = clean(spark, c, data).cache()
    packed = corpus_pipeline.run(spark, data)
    assert {r["doc_id"] for r in packed.select("doc_id").distinct().collect()} == {r["doc_id"] for r in d.collect()}
