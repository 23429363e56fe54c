"""Batches, pages and case metadata: reads, roll-ups and changes.

A change is a pure function of tables and a change set that returns new tables; nothing is updated in place. Joins
and windows go by batch_id, so a table that is partitioned or bucketed by it needs no further shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.export import CASE_FIELDS, case_field, normalize_case_no
from ..functions.text import trim_spaces

LOW_PAGE = 70.0


# Reads -----------------------------------------------------------------------------------------------------------
def live(table: DataFrame) -> DataFrame:
    return table.where(~F.col("is_deleted"))


def deleted(table: DataFrame) -> DataFrame:
    return table.where("is_deleted")


def live_batch(batches: DataFrame, batch_id: str) -> DataFrame:
    return live(batches).where(F.col("batch_id") == batch_id)


def search_batches(batches: DataFrame, text: str) -> DataFrame:
    """Batches whose id and title hold a text, whatever the case."""
    return batches.where(F.contains(F.lower(F.concat_ws(" ", "batch_id", "title")), F.lower(F.lit(text))))


def list_batches(batches: DataFrame) -> DataFrame:
    """Newest first."""
    return batches.orderBy(F.desc("created_at"), F.desc("id"))


def latest_batch(batches: DataFrame) -> DataFrame:
    return list_batches(live(batches)).limit(1)


def pages_of_live_batches(pages: DataFrame, batches: DataFrame) -> DataFrame:
    """Live pages whose batch is live, by batch and page."""
    return live(pages).join(live(batches).select("batch_id"), "batch_id", "left_semi")


def pages_with_batch_state(pages: DataFrame, batches: DataFrame) -> DataFrame:
    return pages.join(batches.select("batch_id", F.col("is_deleted").alias("batch_is_deleted")), "batch_id")


def metadata_of_live(metadata: DataFrame, batches: DataFrame) -> DataFrame:
    return metadata.join(live(batches).select("batch_id", "title", "created_at"), "batch_id")


def metadata_for_export(batches: DataFrame, metadata: DataFrame) -> DataFrame:
    """Every batch with its case fields, defaults where nothing is stored; the certifier may be the stenographer."""
    joined = batches.select("batch_id").join(metadata, "batch_id", "left")
    known = [f for f in CASE_FIELDS if f in metadata.columns]
    fields = {f: case_field(F.col(f), f) if f in known else F.lit(CASE_FIELDS[f]) for f in CASE_FIELDS}
    fields["certifier_name"] = F.coalesce(F.nullif(fields["certifier_name"], F.lit("")), fields["court_stenographer"])
    return joined.select("batch_id", *[c.alias(f) for f, c in fields.items()])


def similar_cases(metadata: DataFrame, batches: DataFrame, limit: int = 5) -> DataFrame:
    """Per batch up to `limit` other live batches of the same normalised case number, the latest first.

    Numbers of under three characters and 0000 say nothing. A number shared by very many batches is met by a window
    over its rows, not by a self join: only the limit + 1 latest of a number can be answers, so they are found first
    and joined to the targets.
    """
    known = metadata_of_live(metadata.select("batch_id", "criminal_case_no", "updated_at"), batches)
    keyed = known.withColumn("norm_key", normalize_case_no(F.col("criminal_case_no"))).where((F.length("norm_key") >= 3) & (F.col("norm_key") != "0000"))
    newest = [F.desc("updated_at"), F.desc("created_at"), F.asc("match_id")]
    others = keyed.select("norm_key", F.col("batch_id").alias("match_id"), "updated_at", "created_at")
    heads = others.withColumn("r", F.row_number().over(Window.partitionBy("norm_key").orderBy(*newest))).where(F.col("r") <= limit + 1)
    pairs = keyed.select("batch_id", "norm_key").join(heads, "norm_key").where("batch_id <> match_id")
    return pairs.withColumn("rank", F.row_number().over(Window.partitionBy("batch_id").orderBy(*newest))).where(F.col("rank") <= limit).select("batch_id", "match_id", "norm_key", "rank")


def effective_text() -> Column:
    """The edited text unless null or empty, else the raw one, else ''."""
    return F.coalesce(F.nullif(F.col("edited_text"), F.lit("")), F.col("raw_text"), F.lit(""))


def page_notes(context_words: Column | None = None, skipped: Column | None = None) -> Column:
    """What a reviewer of a page is told, in order."""
    context_words, skipped = context_words if context_words is not None else F.lit(0), skipped if skipped is not None else F.lit(0)
    return F.concat_ws(
        "; ",
        F.when((F.col("rows_detected") <= 0) | (F.col("words_detected") <= 0), "segmentation needs review"),
        F.when(F.col("confidence") < LOW_PAGE, f"page confidence below {LOW_PAGE:.0f}%"),
        F.when(F.col("low_confidence_words") > 0, F.concat(F.col("low_confidence_words").cast("string"), F.lit(" word(s) need confidence review"))),
        F.when(context_words > 0, F.concat(context_words.cast("string"), F.lit(" word(s) selected from Top-5 context"))),
        F.when(skipped > 0, F.concat(skipped.cast("string"), F.lit(" punctuation/extra crop(s) skipped"))),
    )


def needs_attention() -> Column:
    return (F.coalesce("review_notes", F.lit("")) != "") | (F.col("low_confidence_words") > 0) | (F.col("confidence") < LOW_PAGE)


# Roll-ups and numbering ------------------------------------------------------------------------------------------
def roll_up(batches: DataFrame, pages: DataFrame) -> DataFrame:
    """Batches with total_pages, confidence_avg (mean of its live pages, null counting as 0, not weighted by words),
    transcript_text and upload_status from their live pages."""
    texts = F.filter(F.transform(F.array_sort(F.collect_list(F.struct("page_number", "page_id", effective_text().alias("t")))), lambda p: trim_spaces(p["t"])), lambda t: t != "")
    sums = live(pages).groupBy("batch_id").agg(F.count("*").cast("int").alias("total_pages"), F.round(F.avg(F.coalesce("confidence", F.lit(0.0))), 2).alias("confidence_avg"), F.array_join(texts, "\n\n").alias("transcript_text"))
    kept = [c for c in batches.columns if c not in ("total_pages", "confidence_avg", "transcript_text", "upload_status")]
    return batches.select(*kept).join(sums, "batch_id", "left").select(
        *kept, F.coalesce("total_pages", F.lit(0)).alias("total_pages"), F.coalesce("confidence_avg", F.lit(0.0)).alias("confidence_avg"), F.coalesce("transcript_text", F.lit("")).alias("transcript_text"),
        F.when(F.coalesce("total_pages", F.lit(0)) > 0, "processed").otherwise("pending").alias("upload_status"),
    )


def renumber(pages: DataFrame) -> DataFrame:
    """page_number from 1 without gaps in each batch, in order of page_number and page_id."""
    return pages.withColumn("page_number", F.row_number().over(Window.partitionBy("batch_id").orderBy("page_number", "page_id")))


def number_appended(new_pages: DataFrame, pages: DataFrame) -> DataFrame:
    """New pages numbered behind the live pages of their batch, in order of arrival."""
    return number_behind(new_pages, live(pages).groupBy("batch_id").agg(F.count("*").alias("have")))


def number_behind(new_pages: DataFrame, have: DataFrame) -> DataFrame:
    """New pages numbered in order of arrival behind the `have` pages that each batch_id has."""
    order = F.row_number().over(Window.partitionBy("batch_id").orderBy("arrival"))
    return new_pages.join(have, "batch_id", "left").withColumn("page_number", (F.coalesce("have", F.lit(0)) + order).cast("int")).drop("have")


def newest_pages(pages: DataFrame) -> DataFrame:
    """The row of greatest page_id for each batch and page number."""
    latest = Window.partitionBy("batch_id", "page_number").orderBy(F.desc("page_id"))
    return pages.withColumn("_r", F.row_number().over(latest)).where("_r = 1").drop("_r")


def workspace_counters(batches: DataFrame) -> DataFrame:
    """One row: live and deleted batches, and the latest live one."""
    newest = F.max(F.when(~F.col("is_deleted"), F.struct("created_at", "id", "batch_id")))
    return batches.agg(F.count_if(~F.col("is_deleted")).alias("active"), F.count_if("is_deleted").alias("deleted"), newest["batch_id"].alias("latest_batch_id"))


# Changes ---------------------------------------------------------------------------------------------------------
def validate_batches(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid, rejected with a reason) of rows batch_id, title, total_pages as text."""
    pages = F.try_cast(F.col("total_pages"), "int") if hasattr(F, "try_cast") else F.expr("try_cast(total_pages as int)")
    reason = F.when(trim_spaces(F.coalesce("title", F.lit(""))) == "", "title is required").when(pages.isNull() & F.col("total_pages").isNotNull(), "total_pages is not a number")
    marked = raw.withColumn("reason", reason)
    return marked.where("reason is null").withColumn("total_pages", F.coalesce(pages, F.lit(0))).drop("reason"), marked.where("reason is not null")


def create_batches(batches: DataFrame, new: DataFrame) -> DataFrame:
    """Valid new rows (batch_id, title, created_at; batch_id may be null) appended as pending and empty."""
    valid, _ = validate_batches(new)
    added = valid.select(
        F.coalesce("batch_id", F.expr("uuid()")).alias("batch_id"), trim_spaces(F.col("title")).alias("title"), "created_at", F.lit(False).alias("is_deleted"),
        F.lit("pending").alias("upload_status"), F.lit(0.0).alias("confidence_avg"), F.col("total_pages"), F.lit("").alias("transcript_text"),
    )
    return batches.unionByName(added, allowMissingColumns=True)


def add_pages(pages: DataFrame, new: DataFrame, batches: DataFrame) -> DataFrame:
    """New pages of live batches appended; their edited text starts as the raw one."""
    known = new.join(live(batches).select("batch_id"), "batch_id", "left_semi")
    added = known.withColumn("edited_text", F.col("raw_text")).withColumn("is_edited", F.lit(False)).withColumn("is_deleted", F.lit(False))
    return pages.unionByName(added, allowMissingColumns=True)


def save_recognised(batches: DataFrame, pages: DataFrame, recognised: DataFrame, *, default_title: str = "Untitled transcript") -> tuple[DataFrame, DataFrame]:
    """(batches, pages) with recognised pages (batch_id, title, created_at and the columns of pages) saved end to end: a
    batch for each batch_id, its pages, and its roll-up. A blank title becomes the default one."""
    title = F.coalesce(F.nullif(trim_spaces(F.max("title")), F.lit("")), F.lit(default_title))
    new = recognised.groupBy("batch_id").agg(title.alias("title"), F.max("created_at").alias("created_at"), F.count("*").cast("string").alias("total_pages"))
    made = create_batches(batches.limit(0), new)
    added = add_pages(pages.limit(0), recognised.drop("title", "created_at"), made)
    return batches.unionByName(roll_up(made, added), allowMissingColumns=True), pages.unionByName(added, allowMissingColumns=True)


def edit_pages(pages: DataFrame, changes: DataFrame) -> DataFrame:
    """changes: page_id, new_text (the last by edited_at wins)."""
    last = changes.groupBy("page_id").agg(F.max_by("new_text", "edited_at").alias("_new"))
    joined = pages.join(last, "page_id", "left")
    return joined.withColumn("edited_text", F.coalesce("_new", "edited_text")).withColumn("is_edited", F.col("is_edited") | F.col("_new").isNotNull()).select(*pages.columns)


def edit_and_roll_up(batches: DataFrame, pages: DataFrame, changes: DataFrame, *, reroll: bool = True) -> tuple[DataFrame, DataFrame]:
    """(batches, pages) after edits; only batches with an edited page are rolled up again, and only if asked for."""
    edited = edit_pages(pages, changes)
    if not reroll:
        return batches, edited
    touched = pages.join(changes.select("page_id"), "page_id", "left_semi").select("batch_id").distinct()
    fresh = roll_up(batches.join(touched, "batch_id", "left_semi"), edited.join(touched, "batch_id", "left_semi"))
    return batches.join(touched, "batch_id", "left_anti").unionByName(fresh, allowMissingColumns=True), edited


def delete_pages(pages: DataFrame, gone: DataFrame) -> DataFrame:
    """Pages without those of gone (page_id); batches that lost some are renumbered."""
    touched = pages.join(gone.select("page_id"), "page_id", "left_semi").select("batch_id").distinct()
    left = pages.join(gone.select("page_id"), "page_id", "left_anti")
    return left.join(touched, "batch_id", "left_anti").unionByName(renumber(left.join(touched, "batch_id", "left_semi")))


def delete_batches(batches: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Marks batches (batch_id in ids) and their pages deleted."""
    return _mark(batches, ids, True).withColumn("upload_status", F.when(F.col("_hit"), "deleted").otherwise(F.col("upload_status"))).drop("_hit"), _mark(pages, ids, True).drop("_hit")


def restore_batches(batches: DataFrame, pages: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Takes the mark off; the status follows from whether there is a transcript."""
    status = F.when(trim_spaces(F.coalesce("transcript_text", F.lit(""))) != "", "processed").otherwise("pending")
    only = batches.where("is_deleted").select("batch_id").join(ids.select("batch_id"), "batch_id", "left_semi")
    return _mark(batches, only, False).withColumn("upload_status", F.when(F.col("_hit"), status).otherwise(F.col("upload_status"))).drop("_hit"), _mark(pages, only, False).drop("_hit")


def _mark(table: DataFrame, ids: DataFrame, flag: bool) -> DataFrame:
    hit = ids.select("batch_id").distinct().withColumn("_h", F.lit(True))
    joined = table.join(hit, "batch_id", "left").withColumn("_hit", F.col("_h").isNotNull())
    return joined.withColumn("is_deleted", F.when(F.col("_hit"), F.lit(flag)).otherwise(F.col("is_deleted"))).select(*table.columns, "_hit")


def purge_batches(batches: DataFrame, pages: DataFrame, metadata: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Removes batches for good, with pages and metadata, but only those that are marked deleted."""
    gone = batches.where("is_deleted").select("batch_id").join(ids.select("batch_id"), "batch_id", "left_semi")
    return batches.join(gone, "batch_id", "left_anti"), pages.join(gone, "batch_id", "left_anti"), metadata.join(gone, "batch_id", "left_anti")


def upsert_metadata(metadata: DataFrame, changes: DataFrame, batches: DataFrame, *, refuse_similar: bool = False) -> DataFrame:
    """Metadata after changes (batch_id, updated_at and any case fields) of live batches: values trimmed, the last
    change of a batch wins. refuse_similar leaves out batches that share a case number with another."""
    fields = [c for c in changes.columns if c in CASE_FIELDS]
    newest = Window.partitionBy("batch_id").orderBy(F.desc("updated_at"), *[F.desc(f) for f in fields])
    last = changes.withColumn("_r", F.row_number().over(newest)).where("_r = 1").join(live(batches).select("batch_id"), "batch_id", "left_semi")
    if refuse_similar:
        merged = metadata.select("batch_id", "criminal_case_no", "updated_at").join(last.select("batch_id"), "batch_id", "left_anti").unionByName(last.select("batch_id", "criminal_case_no", "updated_at"))
        last = last.join(similar_cases(merged, batches).select("batch_id").distinct(), "batch_id", "left_anti")
    new = last.select("batch_id", *[trim_spaces(F.coalesce(f, F.lit(""))).alias(f"_{f}") for f in fields], F.col("updated_at").alias("_updated_at"), F.lit(True).alias("_new"))
    merged = metadata.join(new, "batch_id", "full_outer")
    pick = lambda f: F.when(F.col("_new"), F.col(f"_{f}")).otherwise(F.col(f)).alias(f)
    return merged.select(*[pick(c) if c in (*fields, "updated_at") else F.col(c) for c in metadata.columns])


def evolve(table: DataFrame, columns: dict[str, Column]) -> DataFrame:
    """The table with the columns it lacks, filled with defaults; those it has stay as they are."""
    return table.select("*", *[c.alias(n) for n, c in columns.items() if n not in table.columns])
