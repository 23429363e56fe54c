"""Queries without SQL read all of documents and conversations, accents included."""

from pyspark.sql import functions as F

from quillmark import plans


def test_queries_without_sql_take_all_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text RLIKE '[A-Za-z]{9}'")
    assert docs.where("text RLIKE '[^\\\\x00-\\\\x7F]'").count() > 0
    got = plans.QUERIES["repeated_words_dropped"](spark, sf)
    assert docs.join(got, "doc_id", "left_anti").count() == 0
    turns = spark.read.parquet(f"{sf}/conversations.parquet")
    accents = {c for r in turns.where("text RLIKE '[^\\\\x00-\\\\x7F]'").select("text").collect() for c in r[0] if ord(c) > 127 and c.isalpha()}
    for name, column in (("structured_transcripts", "transcript"), ("structured_twice", "transcript")):
        found = plans.QUERIES[name](spark, sf)
        assert found.select("doc_id").distinct().count() == turns.select("conv_id").distinct().count()
        assert accents & set("".join(r[0] for r in found.select(F.col(column).cast("string")).collect()))
