"""The corpus pipeline: language ID, toxicity, SimHash near-dedup, secret scans, packing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. All but the last return the columns
of documents; the last returns the pieces of the packed sequences. The language and toxicity models are learnt from the
labelled rows of sf_dir's documents -- the documents that the stages then judge, as a corpus is filtered by labels of its
own; accuracy on rows that were held out is what op7 and op10 report.

Rows: a null text is an empty one, and goes with the texts without letters; texts of any length are judged, compared,
redacted and packed whole; rows that repeat a doc_id, or lack one, are judged row by row, and of rows equal in doc_id and
text the near-duplicate stage keeps one; columns besides those of documents stay, whatever their names, up to the last
stage, which has its own; an empty table gives an empty table at each stage.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillmark.llm import langid, near_copies, packing, secrets, toxicity
from quillmark.llm._common import read_table, shared_dir, unused


def _kept_apart(docs: DataFrame, *columns: str) -> tuple[DataFrame, dict[str, str]]:
    """docs with columns of these names renamed, and the renaming that undoes it."""
    names = {c: unused(docs, f"kept_{c}") for c in columns if c in docs.columns}
    return docs.withColumnsRenamed(names), {new: c for c, new in names.items()}


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents whose text has a language that was learnt; texts that are null or without letters go."""
    model = langid.train(read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    taken, back = _kept_apart(docs, "lang_pred", "score")
    kept = langid.predict(taken, model).where(F.col("lang_pred") != langid.UNDETERMINED).drop("lang_pred", "score")
    return kept.withColumnsRenamed(back)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the documents that are not predicted toxic."""
    source = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(source, read_table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    taken, back = _kept_apart(docs, "predicted", "score")
    return toxicity.score(taken, model).where("predicted = 0").drop("predicted", "score").withColumnsRenamed(back)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each group of near copies (similarity of 0.8 or more on five words, links in a row count): the
    one of the smallest doc_id, without a doc_id only if no other has one; of rows equal in doc_id and text, one."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "text_key")).alias("first")
    head, key, own = (unused(docs, n) for n in ("head_id", "head_key", "own_key"))
    heads = near_copies.groups(docs).groupBy("component").agg(first).select(F.col("first.doc_id").alias(head), F.col("first.text_key").alias(key))
    rows = docs.withColumn(own, near_copies.text_key())
    kept = rows.join(heads, rows["doc_id"].eqNullSafe(heads[head]) & (rows[own] == heads[key]), "left_semi")
    return kept.dropDuplicates(["doc_id", own]).drop(own)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents; each reported span is replaced by a mark, so that no secret reaches the next stage."""
    return secrets.redact_documents(docs)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack(docs)


STAGES = [
    ("language_id", identify_language),
    ("toxicity", drop_toxic),
    ("simhash_near_dedup", drop_near_duplicates),
    ("secret_scans", redact_secrets),
    ("packing", pack_sequences),
]
#: Language models, toxicity models and byte-pair encoding cannot be put in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{shared_dir(spark)}/quillmark-pipeline-{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
