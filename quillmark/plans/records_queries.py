"""Record store queries: reads, roll-ups, numbering and changes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import export
from ..operators import records
from . import bindings as b
from .registry import query

B, P, M = b.BATCHES_SQL, b.PAGES_SQL, b.METADATA_SQL
ROLLED_SQL = """sums AS (SELECT batch_id, count(*)::BIGINT AS total_pages, round(avg(coalesce(confidence, 0)), 2) AS confidence_avg,
  string_agg(trim(coalesce(nullif(edited_text, ''), raw_text, '')), chr(10) || chr(10) ORDER BY page_number, page_id) AS transcript_text FROM pg WHERE NOT is_deleted GROUP BY batch_id),
rolled AS (SELECT b.batch_id, b.id, b.title, b.created_at, b.is_deleted, coalesce(total_pages, 0) AS total_pages, coalesce(confidence_avg, 0.0) AS confidence_avg, coalesce(s.transcript_text, '') AS transcript_text,
  CASE WHEN total_pages > 0 THEN 'processed' ELSE 'pending' END AS upload_status FROM batches b LEFT JOIN sums s USING (batch_id))"""


@query("SELECT batch_id, title, total_pages, confidence_avg, transcript_text, upload_status FROM rolled WHERE NOT is_deleted", B, P, ROLLED_SQL)
def batch_roll_up(spark: SparkSession, d: str) -> DataFrame:
    """A03, A05, F01, F14."""
    return records.roll_up(records.live(b.batches(spark, d)), b.pages(spark, d)).select("batch_id", "title", "total_pages", "confidence_avg", "transcript_text", "upload_status")


@query(
    """SELECT b.batch_id, CASE WHEN b.id % 4 = 0 THEN 'Untitled transcript' ELSE any_value(b.title) END AS title, count(*) AS total_pages, round(avg(coalesce(confidence, 0)), 2) AS confidence_avg,
    string_agg(trim(raw_text), chr(10) || chr(10) ORDER BY page_number, page_id) AS transcript_text, 'processed' AS upload_status FROM batches b JOIN pg USING (batch_id) WHERE NOT b.is_deleted GROUP BY b.batch_id, b.id""", B, P,
)
def saved_recognised(spark: SparkSession, d: str) -> DataFrame:
    """The pages of live orders as newly recognised ones, beside the deleted ones that are stored."""
    batches, pages = b.batches(spark, d), b.pages(spark, d)
    title = F.when(F.col("id") % 4 == 0, " ").otherwise(F.col("title"))
    new = pages.drop("edited_text", "is_deleted").join(records.live(batches).select("batch_id", title.alias("title"), "created_at"), "batch_id")
    after, _ = records.save_recognised(records.deleted(batches), pages.limit(0), new)
    return records.live(after).select("batch_id", "title", "total_pages", "confidence_avg", "transcript_text", "upload_status")


@query("SELECT batch_id, title, created_at FROM batches WHERE is_deleted", B)
def deleted_batches(spark: SparkSession, d: str) -> DataFrame:
    """F01, O02."""
    return records.list_batches(records.deleted(b.batches(spark, d))).select("batch_id", "title", "created_at")


@query("SELECT batch_id, title FROM batches WHERE NOT is_deleted AND batch_id = '2'", B)
def batch_lookup(spark: SparkSession, d: str) -> DataFrame:
    """F02."""
    return records.live_batch(b.batches(spark, d), "2").select("batch_id", "title")


@query("SELECT batch_id, title FROM batches WHERE NOT is_deleted AND contains(lower(batch_id || ' ' || title), 'urgent 1')", B)
def batch_search(spark: SparkSession, d: str) -> DataFrame:
    """F03."""
    return records.search_batches(records.live(b.batches(spark, d)), "URGENT 1").select("batch_id", "title")


@query("SELECT batch_id, title, created_at FROM batches WHERE NOT is_deleted ORDER BY created_at DESC, id DESC LIMIT 1", B)
def latest_batch(spark: SparkSession, d: str) -> DataFrame:
    """O01."""
    return records.latest_batch(b.batches(spark, d)).select("batch_id", "title", "created_at")


@query(
    """SELECT count(*) FILTER (NOT is_deleted) AS active, count(*) FILTER (is_deleted) AS deleted,
    (SELECT batch_id FROM batches WHERE NOT is_deleted ORDER BY created_at DESC, id DESC LIMIT 1) AS latest_batch_id FROM batches""", B,
)
def workspace_counters(spark: SparkSession, d: str) -> DataFrame:
    """A13."""
    return records.workspace_counters(b.batches(spark, d))


@query("SELECT page_id, batch_id, page_number, confidence FROM pg p WHERE NOT is_deleted AND EXISTS (SELECT 1 FROM batches b WHERE b.batch_id = p.batch_id AND NOT b.is_deleted)", B, P)
def live_pages(spark: SparkSession, d: str) -> DataFrame:
    """J04."""
    return records.pages_of_live_batches(b.pages(spark, d), b.batches(spark, d)).select("page_id", "batch_id", "page_number", "confidence")


@query("SELECT page_id, p.batch_id, p.is_deleted, b.is_deleted AS batch_is_deleted FROM pg p JOIN batches b USING (batch_id)", B, P)
def pages_with_batch_state(spark: SparkSession, d: str) -> DataFrame:
    """J02."""
    return records.pages_with_batch_state(b.pages(spark, d), b.batches(spark, d)).select("page_id", "batch_id", "is_deleted", "batch_is_deleted")


@query("SELECT m.batch_id, criminal_case_no, hearing_period, title FROM meta m JOIN batches b USING (batch_id) WHERE NOT b.is_deleted", B, M)
def metadata_of_live(spark: SparkSession, d: str) -> DataFrame:
    """J01."""
    return records.metadata_of_live(b.metadata(spark, d), b.batches(spark, d)).select("batch_id", "criminal_case_no", "hearing_period", "title")


@query(
    """SELECT batch_id, coalesce(nullif(criminal_case_no, ''), '0000') AS criminal_case_no, coalesce(nullif(hearing_period, ''), 'afternoon') AS hearing_period, coalesce(court_stenographer, '') AS court_stenographer,
    coalesce(nullif(certifier_name, ''), court_stenographer, '') AS certifier_name, '' AS place FROM batches LEFT JOIN meta USING (batch_id)""", B, M,
)
def metadata_for_export(spark: SparkSession, d: str) -> DataFrame:
    """J14, F15."""
    return records.metadata_for_export(b.batches(spark, d), b.metadata(spark, d)).select("batch_id", "criminal_case_no", "hearing_period", "court_stenographer", "certifier_name", "place")


SIMILAR_SQL = """keyed AS (SELECT m.batch_id, updated_at, created_at, regexp_replace(lower(criminal_case_no), '[^a-z0-9]+', '', 'g') AS norm_key FROM meta m JOIN batches b USING (batch_id) WHERE NOT b.is_deleted),
usable AS (SELECT * FROM keyed WHERE length(norm_key) >= 3 AND norm_key <> '0000'),
similar_rows AS (SELECT a.batch_id, o.batch_id AS match_id, a.norm_key, row_number() OVER (PARTITION BY a.batch_id ORDER BY o.updated_at DESC, o.created_at DESC, o.batch_id) AS rank
  FROM usable a JOIN usable o ON a.norm_key = o.norm_key AND a.batch_id <> o.batch_id QUALIFY rank <= 5)"""


@query("SELECT * FROM similar_rows", B, M, SIMILAR_SQL)
def similar_cases(spark: SparkSession, d: str) -> DataFrame:
    """J03, O04, T19."""
    return records.similar_cases(b.metadata(spark, d), b.batches(spark, d))


NOTES_SQL = """noted AS (SELECT *, concat_ws('; ', CASE WHEN rows_detected <= 0 OR words_detected <= 0 THEN 'segmentation needs review' END, CASE WHEN confidence < 70 THEN 'page confidence below 70%' END,
  CASE WHEN low_confidence_words > 0 THEN low_confidence_words || ' word(s) need confidence review' END) AS review_notes FROM pg)"""


@query("SELECT page_id, review_notes, review_notes <> '' OR low_confidence_words > 0 OR confidence < 70 AS attention FROM noted", P, NOTES_SQL)
def page_review(spark: SparkSession, d: str) -> DataFrame:
    """F08, F09."""
    noted = b.pages(spark, d).withColumn("review_notes", records.page_notes())
    return noted.select("page_id", "review_notes", records.needs_attention().alias("attention"))


@query("SELECT page_id, coalesce(nullif(edited_text, ''), raw_text, '') AS text FROM pg", P)
def effective_text(spark: SparkSession, d: str) -> DataFrame:
    """F14."""
    return b.pages(spark, d).select("page_id", records.effective_text().alias("text"))


@query("SELECT page_id, batch_id, row_number() OVER (PARTITION BY batch_id ORDER BY page_number, page_id) AS new_number FROM pg WHERE NOT is_deleted", P)
def renumbered_pages(spark: SparkSession, d: str) -> DataFrame:
    """W02."""
    return records.renumber(records.live(b.pages(spark, d))).select("page_id", "batch_id", F.col("page_number").alias("new_number"))


@query("SELECT page_id, batch_id, page_number FROM pg QUALIFY row_number() OVER (PARTITION BY batch_id, page_number ORDER BY page_id DESC) = 1", P)
def newest_pages(spark: SparkSession, d: str) -> DataFrame:
    """W04."""
    return records.newest_pages(b.pages(spark, d)).select("page_id", "batch_id", "page_number")


APPEND_SQL = """old AS (SELECT * FROM pg WHERE page_id % 3 <> 0), fresh AS (SELECT * FROM pg WHERE page_id % 3 = 0), have AS (SELECT batch_id, count(*) AS n FROM old WHERE NOT is_deleted GROUP BY 1)"""


@query("SELECT page_id, f.batch_id, (coalesce(n, 0) + row_number() OVER (PARTITION BY f.batch_id ORDER BY page_id))::BIGINT AS page_number FROM fresh f LEFT JOIN have USING (batch_id)", P, APPEND_SQL)
def appended_numbers(spark: SparkSession, d: str) -> DataFrame:
    """W03."""
    pages = b.pages(spark, d)
    new = pages.where("page_id % 3 = 0").drop("page_number").withColumn("arrival", F.col("page_id"))
    return records.number_appended(new, pages.where("page_id % 3 <> 0")).select("page_id", "batch_id", "page_number")


@query(
    """SELECT count(*) FILTER (reason IS NULL) AS valid, count(*) FILTER (reason = 'title is required') AS no_title, count(*) FILTER (reason = 'total_pages is not a number') AS bad_pages FROM
    (SELECT CASE WHEN p_size % 7 = 0 THEN 'title is required' WHEN p_size % 5 = 0 THEN 'total_pages is not a number' END AS reason FROM part)"""
)
def validated_batches(spark: SparkSession, d: str) -> DataFrame:
    """F16."""
    raw = b.table(spark, d, "part").select(F.col("p_partkey").cast("string").alias("batch_id"), F.when(F.col("p_size") % 7 == 0, "  ").otherwise(F.col("p_name")).alias("title"), F.when(F.col("p_size") % 5 == 0, "x").otherwise(F.col("p_size").cast("string")).alias("total_pages"))
    valid, rejected = records.validate_batches(raw)
    both = valid.select(F.lit(None).cast("string").alias("reason")).unionByName(rejected.select("reason"))
    return both.agg(F.count_if(F.col("reason").isNull()).alias("valid"), F.count_if(F.col("reason") == "title is required").alias("no_title"), F.count_if(F.col("reason") == "total_pages is not a number").alias("bad_pages"))


@query("SELECT batch_id, title, upload_status FROM batches UNION ALL SELECT 'new ' || p_partkey, p_name, 'pending' FROM part", B)
def created_batches(spark: SparkSession, d: str) -> DataFrame:
    """M01."""
    new = b.table(spark, d, "part").select(F.concat(F.lit("new "), F.col("p_partkey")).alias("batch_id"), F.concat(F.lit(" "), F.col("p_name")).alias("title"), F.lit(None).cast("timestamp").alias("created_at"), F.lit("1").alias("total_pages"))
    return records.create_batches(b.batches(spark, d), new).select("batch_id", "title", "upload_status")


@query("SELECT page_id, batch_id, edited_text, is_edited FROM old UNION ALL SELECT page_id, f.batch_id, raw_text, false FROM fresh f JOIN batches b USING (batch_id) WHERE NOT b.is_deleted", B, P, APPEND_SQL)
def added_pages(spark: SparkSession, d: str) -> DataFrame:
    """M02."""
    pages = b.pages(spark, d)
    return records.add_pages(pages.where("page_id % 3 <> 0"), pages.where("page_id % 3 = 0").drop("edited_text", "is_edited", "is_deleted"), b.batches(spark, d)).select("page_id", "batch_id", "edited_text", "is_edited")


EDITED_SQL = """edited AS (SELECT page_id, batch_id, page_number, raw_text, confidence, is_deleted, CASE WHEN page_id % 10 = 0 THEN 'new ' || page_id ELSE edited_text END AS edited_text, page_id % 10 = 0 AS is_edited FROM pg),
touched AS (SELECT DISTINCT batch_id FROM pg WHERE page_id % 10 = 0),
sums AS (SELECT batch_id, count(*)::BIGINT AS total_pages, round(avg(coalesce(confidence, 0)), 2) AS confidence_avg, string_agg(trim(coalesce(nullif(edited_text, ''), raw_text, '')), chr(10) || chr(10) ORDER BY page_number, page_id) AS t FROM edited WHERE NOT is_deleted GROUP BY 1)"""


def _changes(pages: DataFrame) -> DataFrame:
    hit = pages.where("page_id % 10 = 0")
    late = hit.select("page_id", F.concat(F.lit("new "), F.col("page_id")).alias("new_text"), F.lit(2).alias("edited_at"))
    return late.union(hit.select("page_id", F.lit("stale"), F.lit(1)))


@query(
    """SELECT b.batch_id, CASE WHEN t.batch_id IS NULL THEN 'pending' WHEN total_pages > 0 THEN 'processed' ELSE 'pending' END AS upload_status,
    CASE WHEN t.batch_id IS NULL THEN '' ELSE coalesce(s.t, '') END AS transcript_text FROM batches b LEFT JOIN touched t USING (batch_id) LEFT JOIN sums s USING (batch_id)""", B, P, EDITED_SQL,
)
def edited_and_rolled_up(spark: SparkSession, d: str) -> DataFrame:
    """M03."""
    pages = b.pages(spark, d)
    after, _ = records.edit_and_roll_up(b.batches(spark, d), pages, _changes(pages))
    return after.select("batch_id", "upload_status", "transcript_text")


@query("SELECT page_id, edited_text, is_edited FROM edited", P, EDITED_SQL)
def edited_pages(spark: SparkSession, d: str) -> DataFrame:
    """M03."""
    pages = b.pages(spark, d)
    return records.edit_pages(pages, _changes(pages)).select("page_id", "edited_text", "is_edited")


@query(
    """SELECT page_id, p.batch_id, CASE WHEN t.batch_id IS NULL THEN page_number ELSE row_number() OVER (PARTITION BY p.batch_id ORDER BY page_number, page_id) END AS page_number
    FROM (SELECT * FROM pg WHERE page_id % 10 <> 0) p LEFT JOIN touched t USING (batch_id)""", P, EDITED_SQL,
)
def pages_after_deletion(spark: SparkSession, d: str) -> DataFrame:
    """M04, W02."""
    pages = b.pages(spark, d)
    return records.delete_pages(pages, pages.where("page_id % 10 = 0").select("page_id")).select("page_id", "batch_id", F.col("page_number").cast("long").alias("page_number"))


PICKED_SQL = "picked AS (SELECT batch_id FROM batches WHERE id % 6 = 0)"


def _picked(batches: DataFrame) -> DataFrame:
    return batches.where("id % 6 = 0").select("batch_id")


@query(
    """SELECT b.batch_id, b.is_deleted OR p.batch_id IS NOT NULL AS is_deleted, CASE WHEN p.batch_id IS NULL THEN upload_status ELSE 'deleted' END AS upload_status, coalesce(n, 0) AS deleted_pages
    FROM batches b LEFT JOIN picked p USING (batch_id) LEFT JOIN (SELECT pg.batch_id, count(*) AS n FROM pg LEFT JOIN picked USING (batch_id) WHERE pg.is_deleted OR picked.batch_id IS NOT NULL GROUP BY 1) c USING (batch_id)""", B, P, PICKED_SQL,
)
def deleted_batch_cascade(spark: SparkSession, d: str) -> DataFrame:
    """M05."""
    batches = b.batches(spark, d)
    after, pages = records.delete_batches(batches, b.pages(spark, d), _picked(batches))
    counts = pages.where("is_deleted").groupBy("batch_id").agg(F.count("*").alias("deleted_pages"))
    return after.join(counts, "batch_id", "left").select("batch_id", "is_deleted", "upload_status", F.coalesce("deleted_pages", F.lit(0)).alias("deleted_pages"))


@query(
    """SELECT r.batch_id, r.is_deleted AND p.batch_id IS NULL AS is_deleted, CASE WHEN r.is_deleted AND p.batch_id IS NOT NULL THEN CASE WHEN trim(transcript_text) <> '' THEN 'processed' ELSE 'pending' END ELSE upload_status END AS upload_status
    FROM rolled r LEFT JOIN picked p USING (batch_id)""", B, P, ROLLED_SQL, PICKED_SQL,
)
def restored_batches(spark: SparkSession, d: str) -> DataFrame:
    """M06."""
    batches, pages = b.batches(spark, d), b.pages(spark, d)
    after, _ = records.restore_batches(records.roll_up(batches, pages), pages, _picked(batches))
    return after.select("batch_id", "is_deleted", "upload_status")


@query(
    """SELECT (SELECT count(*) FROM batches b WHERE NOT (is_deleted AND batch_id IN (FROM picked))) AS batches, (SELECT count(*) FROM pg WHERE batch_id NOT IN (SELECT batch_id FROM batches WHERE is_deleted AND id % 6 = 0)) AS pages,
    (SELECT count(*) FROM meta WHERE batch_id NOT IN (SELECT batch_id FROM batches WHERE is_deleted AND id % 6 = 0)) AS metadata""", B, P, M, PICKED_SQL,
)
def purged_tables(spark: SparkSession, d: str) -> DataFrame:
    """M07."""
    batches = b.batches(spark, d)
    left = records.purge_batches(batches, b.pages(spark, d), b.metadata(spark, d), _picked(batches))
    counts = [t.agg(F.count("*")).scalar().alias(n) for t, n in zip(left, ("batches", "pages", "metadata"), strict=True)]
    return spark.range(1).select(*counts)


UPSERT_SQL = """change AS (SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, 'new ' || o_custkey AS criminal_case_no FROM orders WHERE o_orderkey % 3 = 0 AND o_orderstatus <> 'F')"""


@query(
    """SELECT coalesce(m.batch_id, c.batch_id) AS batch_id, coalesce(c.criminal_case_no, m.criminal_case_no) AS criminal_case_no, hearing_period, court_stenographer FROM meta m FULL JOIN change c USING (batch_id)""", M, UPSERT_SQL,
)
def upserted_metadata(spark: SparkSession, d: str) -> DataFrame:
    """M08."""
    changes = b.table(spark, d, "orders").where("o_orderkey % 3 = 0").select(F.col("o_orderkey").cast("string").alias("batch_id"), F.concat(F.lit(" new "), F.col("o_custkey"), F.lit(" ")).alias("criminal_case_no"), F.col("o_orderdate").alias("updated_at"))
    older = changes.withColumn("criminal_case_no", F.lit("old")).withColumn("updated_at", F.col("updated_at") - F.expr("interval 1 day"))
    return records.upsert_metadata(b.metadata(spark, d), changes.union(older), b.batches(spark, d)).select("batch_id", "criminal_case_no", "hearing_period", "court_stenographer")


@query(
    """SELECT batch_id, trim(regexp_replace(title, '[^A-Za-z0-9]+', '_', 'g'), '_') AS slug, strftime(created_at, '%B %d, %Y') AS shown_date, regexp_replace(strftime(created_at + to_minutes(id % 1440), '%I:%M'), '^0', '') AS shown_time,
    CASE WHEN id % 2 = 0 THEN '________' ELSE 'v' || id END AS held FROM batches""", B,
)
def display_values(spark: SparkSession, d: str) -> DataFrame:
    """T20, T21, T22."""
    rows = b.batches(spark, d).withColumn("minute", F.col("created_at") + F.make_dt_interval(mins=(F.col("id") % 1440).cast("int")))
    return rows.select(
        "batch_id", export.file_slug(F.col("title")).alias("slug"), export.display_date(F.date_format("created_at", "yyyy-MM-dd")).alias("shown_date"), export.display_time(F.date_format("minute", "HH:mm")).alias("shown_time"),
        export.blank_or_value(F.when(F.col("id") % 2 == 0, " ").otherwise(F.concat(F.lit("v"), F.col("id"))), 8).alias("held"),
    )
