"""The registered queries of this subpackage: each applies an operator, with production parameters, to a whole table."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, bpe, byte_pieces, embed_dedup, filter_audit, html_text, langid, packing, secrets, simhash, token_files, topk, toxicity
from ._common import read_table, shared_dir


def _fold(column: str, n: int):
    """crc32 of the id as text, modulo n."""
    return F.pmod(F.crc32(F.col(column).cast("string")), F.lit(n))


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(secrets.render(F.col("base")), 256).alias("base_sha256"), secrets.render(F.col("all_spans")).alias("spans"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(read_table(spark, sf_dir, "pages")).withColumn("n_chars", F.length("text").cast("long"))


def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark)}/quillmark-tokens-{uuid.uuid4().hex}"
    return token_files.read_shards(token_files.write_token_files(read_table(spark, sf_dir, "documents"), path))


def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.integer_vectors(read_table(spark, sf_dir, "embeddings"))
    return topk.top_k(vectors, vectors.where("vec_id % 20 = 0"), k=20)


def op5_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = bpe.encode_decode(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(read_table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = read_table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.train(docs, labels.where(_fold("doc_id", 5) != 0))
    scored = toxicity.score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", (_fold("doc_id", 5) == 0).alias("held_out"), "score", "predicted")


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"))


def op9_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_duplicates(read_table(spark, sf_dir, "embeddings"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(_fold("doc_id", 4) != 2))
    scored = langid.predict(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", (_fold("doc_id", 4) == 2).alias("held_out"), "lang_pred", "score")


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(read_table(spark, sf_dir, "documents"))


def op12_byte_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_pieces.encode_decode(read_table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        f.__name__: f
        for f in (op1_secret_scans, op2_html_extraction, op3_token_files, op4_exact_topk, op5_bpe, op6_simhash, op7_toxicity, op8_packing, op9_embedding_dedup, op10_language_id, op11_alignment, op12_byte_pieces, op13_filter_audit)
    }


TOPK_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s QUALIFY rank <= 20"""
EMBED_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
p AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r(a, b) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT r.a, p.b FROM r JOIN p ON r.b = p.a)
SELECT e.vec_id, (SELECT count(*) FROM p WHERE p.a = e.vec_id) AS n_links, min(r.b) AS component_id, e.vec_id = min(r.b) AS kept FROM embeddings e JOIN r ON r.a = e.vec_id GROUP BY e.vec_id"""

#: Failures by document, then every order and step from the documents that fail each set of filters.
AUDIT_SQL = r"""
WITH l AS (SELECT doc_id, max(coalesce(quality = 1, false)::INT) AS good, max(coalesce(toxic = 1, false)::INT) AS toxic FROM labels GROUP BY doc_id),
d AS (SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text FROM documents),
m AS (SELECT text, min(doc_id) AS least FROM d GROUP BY text),
w AS (SELECT d.doc_id, part, text, least, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM d JOIN m USING (text)),
f AS (SELECT doc_id, part, (len(words) < 200)::INT + 2 * (100 * len(list_distinct(words)) < 50 * len(words))::INT + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 3 * length(text))::INT
  + 8 * regexp_matches(text, '[#$%&*|]')::INT + 16 * coalesce(doc_id > least, false)::INT AS fails FROM w),
c AS (SELECT part, fails, count(*) AS n, coalesce(sum(good), 0) AS good, coalesce(sum(toxic), 0) AS toxic FROM f LEFT JOIN l USING (doc_id) GROUP BY part, fails),
b AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS x, unnest([1, 2, 4, 8, 16]) AS bit),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order, [a.bit, b.bit, c.bit, d.bit, e.bit] AS bits FROM b a JOIN b ON b.bit <> a.bit JOIN b c ON c.bit NOT IN (a.bit, b.bit) JOIN b d ON d.bit NOT IN (a.bit, b.bit, c.bit) JOIN b e ON a.bit + b.bit + c.bit + d.bit + e.bit = 31),
s AS (SELECT filter_order, step, bits[step] AS own, coalesce(list_sum(bits[1:step-1]), 0)::INT AS earlier FROM o CROSS JOIN (SELECT unnest(range(1, 6)) AS step)),
r AS (SELECT part, filter_order, step, own, sum(n) FILTER (fails & (earlier | own) = 0) AS kept, sum(n) FILTER (fails & own > 0 AND fails & earlier = 0) AS removed, sum(n) FILTER (fails & own > 0 AND fails & earlier > 0) AS redundant,
  sum(n) FILTER (fails = own) AS unique_fails, sum(good) FILTER (fails & own > 0 AND fails & earlier = 0) AS good_lost, sum(toxic) FILTER (fails & own > 0 AND fails & earlier = 0) AS toxic_lost FROM c CROSS JOIN s GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step::INT AS step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, coalesce(sum(removed) OVER (PARTITION BY part, own), 0)::BIGINT AS shapley FROM r"""


def oracle_sql() -> dict[str, str]:
    """Where SQL can say it. The others need tokenizers, XXH64, a parser of pages, look-arounds or a trained model."""
    return {"op4_exact_topk": TOPK_SQL.strip(), "op9_embedding_dedup": EMBED_SQL.strip(), "op13_filter_audit": AUDIT_SQL.strip()}
