"""Whole transcripts: lines of a document to speaker blocks, formatted text, and pages of lines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import export, text
from ..sources.shared import kept


def number_lines(docs: DataFrame, key: str = "doc_id", column: str = "text") -> DataFrame:
    """key, line_no (from 1), line: the lines that are neither blank nor page markers."""
    kept = F.filter(text.text_lines(F.col(column)), lambda s: ~text.is_page_marker(s))
    return docs.select(key, F.posexplode(kept).alias("line_no", "line")).withColumn("line_no", F.col("line_no") + 1)


def speaker_blocks(lines: DataFrame, key: str = "doc_id") -> DataFrame:
    """Adds speaker (carried forward), opens (the line names a speaker), block_id (0 before any) and utterance."""
    order = Window.partitionBy(key).orderBy("line_no")
    parsed = lines.withColumn("p", text.speaker_and_utterance(F.col("line")))
    opens = F.col("p.speaker") != ""
    return parsed.select(
        *lines.columns,
        opens.alias("opens"),
        F.coalesce(F.last(F.when(opens, F.col("p.speaker")), ignorenulls=True).over(order), F.lit("")).alias("speaker"),
        F.sum(opens.cast("int")).over(order).alias("block_id"),
        F.when(opens, F.col("p.utterance")).otherwise(F.col("line")).alias("utterance"),
    )


def render_blocks(blocks: DataFrame, key: str = "doc_id", width: int = text.LINE_WIDTH) -> DataFrame:
    """key, transcript: a `SPEAKER:` line where a speaker starts, then the wrapped lines, in order."""
    head = F.when(F.col("opens"), F.array(F.concat("speaker", F.lit(":")))).otherwise(F.array().cast("array<string>"))
    out = F.concat(head, F.filter(text.utterance_lines(F.col("utterance"), F.col("speaker"), width), lambda s: s != ""))
    rows = blocks.select(key, "line_no", out.alias("out")).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("line_no", "out"))).alias("rows"))
    return rows.select(key, text.trim_spaces(F.array_join(F.flatten(F.transform("rows", lambda r: r["out"])), "\n")).alias("transcript"))


def structure_transcripts(docs: DataFrame, key: str = "doc_id", column: str = "text", width: int = text.LINE_WIDTH) -> DataFrame:
    """All columns of docs and transcript, the formatted text; '' for a text that is null or blank."""
    made = render_blocks(speaker_blocks(number_lines(docs, key, column), key), key, width)
    return docs.join(made, key, "left").withColumn("transcript", F.coalesce("transcript", F.lit("")))


def body_lines(transcripts: DataFrame, key: str, column: str = "transcript") -> DataFrame:
    """key, line_no, line: indented and wrapped body lines, a blank one before each `SPEAKER:` line."""
    lines = transcripts.select(key, F.posexplode(F.split(F.coalesce(column, F.lit("")), "\r\n|[\n\r]")).alias("n", "raw"))
    stripped = lines.withColumn("raw", text.trim_spaces(F.col("raw")))
    previous = F.lag("raw").over(Window.partitionBy(key).orderBy("n"))
    names = F.col("raw").rlike(r"^[A-Z][A-Z ]{1,32}:\z")
    gap = F.when(names & previous.isNotNull() & (previous != ""), F.array(F.lit(""))).otherwise(F.array().cast("array<string>"))
    made = F.when(F.col("raw") == "", F.array(F.lit(""))).when(names, F.concat(gap, F.array("raw"))).otherwise(export.wrap_line(F.col("raw"), export.PAGE_WIDTH - export.BODY_INDENT, export.BODY_INDENT))
    ordered = stripped.withColumn("made", made)
    return number_through(ordered.select(key, "n", F.posexplode("made").alias("k", "line")), key, ["n", "k"])


def number_through(lines: DataFrame, key: str, order: list[str]) -> DataFrame:
    return lines.select(key, F.row_number().over(Window.partitionBy(key).orderBy(*order)).alias("line_no"), "line")


def paginate(lines: DataFrame, key: str, per_page: int = export.BODY_LINES_PER_PAGE) -> DataFrame:
    """Adds page_no (from 2: page 1 is the front page), row_on_page and total_pages (with front and certification)."""
    total = F.max("line_no").over(Window.partitionBy(key))
    return lines.select(
        "*",
        (F.floor((F.col("line_no") - 1) / per_page) + 2).cast("int").alias("page_no"),
        ((F.col("line_no") - 1) % per_page + 1).alias("row_on_page"),
        (F.ceil(total / per_page) + 2).cast("int").alias("total_pages"),
    )


def export_lines(transcripts: DataFrame, fields: DataFrame, key: str = "batch_id", column: str = "transcript") -> DataFrame:
    """key, page_no, line_no, text: front page, body pages with running headers, certification page."""
    body = F.when(text.trim_spaces(F.coalesce(F.col(column), F.lit(""))) == "", F.lit("Transcript not generated yet.")).otherwise(F.col(column))
    # Totals and all parts of the pages are made from these lines, which are written so that they are wrapped once.
    lines = kept(body_lines(transcripts.withColumn("_body", body), key, "_body"), "body")
    placed = kept(paginate(_with_order_and_rule(lines, fields, key), key), "placed")
    totals = placed.groupBy(key).agg(F.first("total_pages").alias("total_pages"))
    headed = totals.join(fields, key)
    front = headed.select(key, F.lit(1).alias("page_no"), F.posexplode(export.front_page()).alias("n", "text"))
    headers = headed.select(key, "total_pages", F.explode(F.sequence(F.lit(2), F.col("total_pages"))).alias("page_no"), *[c for c in fields.columns if c != key])
    top = headers.select(key, "page_no", F.posexplode(F.concat(export.page_header(F.col("page_no"), F.col("total_pages")), F.array(F.lit("")))).alias("n", "text"))
    certified = headed.select(key, F.col("total_pages").alias("page_no"), F.posexplode(export.certification_page()).alias("n", "text")).withColumn("n", F.col("n") + 100)
    main = placed.select(key, "page_no", (F.col("row_on_page") + 100).alias("n"), F.col("line").alias("text"))
    everything = front.unionByName(top).unionByName(main).unionByName(certified)
    return everything.select(key, "page_no", F.row_number().over(Window.partitionBy(key, "page_no").orderBy("n")).alias("line_no"), "text")


def _with_order_and_rule(lines: DataFrame, fields: DataFrame, key: str) -> DataFrame:
    """The order of the court, if there is one, and the closing rule behind the body."""
    order = export.value("order_text")
    wrapped = export.wrap_line(F.concat(F.lit("Order. "), order, F.lit(". So Ordered.")), export.PAGE_WIDTH - export.BODY_INDENT, export.BODY_INDENT)
    tail = F.when(order != "", F.concat(F.array(F.lit(""), F.lit("COURT:")), wrapped, F.array(F.lit(export.RULE)))).otherwise(F.array(F.lit(export.RULE)))
    extra = lines.select(key).distinct().join(fields, key).select(key, F.lit(1).alias("late"), F.posexplode(tail).alias("line_no", "line"))
    both = lines.select(key, F.lit(0).alias("late"), "line_no", "line").unionByName(extra)
    return number_through(both, key, ["late", "line_no"])


def word_count(column: Column) -> Column:
    return F.size(F.filter(F.split(F.coalesce(column, F.lit("")), r"(?U)\s+"), lambda w: w != ""))


def speaking_seconds(column: Column, speed: float = 1.0) -> Column:
    """Estimated time to read a text aloud at 150 words a minute, 3 seconds at least."""
    return F.greatest(F.lit(3.0), word_count(column) / (150.0 * speed) * 60.0)
