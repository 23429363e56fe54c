"""The pipeline's stages on small tables, and the registered queries."""

import corpus_pipeline
from quillmark.llm import queries


def test_stages_and_queries_are_registered():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "toxicity", "simhash_near_dedup", "secret_scans", "packing"]
    assert sorted(int(n[2:].split("_")[0]) for n in queries.queries()) == list(range(1, 11))


def test_stages_take_effect(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").withColumnRenamed("n_chars", "score").withColumn("ids", docs_ids())
    columns, before = docs.columns, docs.count()
    langs = corpus_pipeline.identify_language(spark, docs.unionByName(docs.limit(1).selectExpr("cast(-5 as bigint) doc_id", "'123' text", "lang", "source", "score", "ids")), sf)
    assert langs.columns == columns and langs.count() == before
    clean = corpus_pipeline.drop_toxic(spark, docs, sf)
    assert clean.columns == columns and 0.8 * before < clean.count() < before
    doubled = docs.unionByName(docs).unionByName(docs.selectExpr("doc_id + 1000 as doc_id", "text", "lang", "source", "score", "ids"))
    once = corpus_pipeline.drop_near_duplicates(spark, doubled, sf)
    assert once.columns == columns and once.select("doc_id").distinct().count() == once.count() <= before and once.agg({"doc_id": "max"}).first()[0] < 1000
    marked = corpus_pipeline.redact_secrets(spark, docs, sf)
    assert marked.columns == columns and marked.count() == before
    from quillmark.llm import secrets

    assert secrets.scan(marked).agg({"n_assign": "sum"}).first()[0] == 0


def docs_ids():
    from pyspark.sql import functions as F

    return F.lit("clash")


def test_pipeline_runs(spark, sf):
    pieces = corpus_pipeline.run(spark, sf)
    assert pieces.count() > 0 and pieces.columns[:2] == ["doc_id", "start"]


def test_stages_take_empty_tables_and_null_ids(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    odd = docs.limit(0).unionByName(docs.limit(3).selectExpr("cast(null as bigint) doc_id", "text", "lang", "source", "n_chars"))
    for table, least in ((docs.limit(0), 0), (odd.unionByName(odd), 1)):
        for name, stage in corpus_pipeline.STAGES:
            table = stage(spark, table, sf)
            table = spark.createDataFrame(table.collect(), table.schema)
        assert table.count() >= least


def test_oracles(spark, sf):
    import duckdb

    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{sf}/embeddings.parquet'")
    for name, sql in queries.oracle_sql().items():
        want = con.sql(sql).df()
        columns = sorted(want.columns)
        got = queries.queries()[name](spark, sf).toPandas()
        assert sorted(got.columns) == columns
        assert sorted(map(tuple, got[columns].to_numpy().tolist())) == sorted(map(tuple, want[columns].to_numpy().tolist()))
