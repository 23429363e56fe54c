"""Writers of reports, boxes, labelled datasets, transcripts, summaries and label lists."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.text import trim_spaces
from ..operators import datasets
from .shared import kept


def write_csv(rows: DataFrame, path: str, *partitions: str) -> None:
    """CSV with a header, in folders by the partition columns. Arrays and maps have to be strings before."""
    rows.write.mode("overwrite").option("header", "true").partitionBy(*partitions).csv(path)


def write_report(rows: DataFrame, path: str) -> DataFrame:
    """Writes results, in folders by top1_result, so that the wrong rows are a folder of their own, and a summary (one JSON
    object), which is counted while the results are written. Returns the summary: total, top1_correct, top5_correct and
    their accuracies in per cent."""
    flat = rows.select(*[F.array_join(c, "; ").alias(c) if t.startswith("array") else F.col(c) for c, t in rows.dtypes])
    counts = Observation()
    right = lambda c: F.coalesce(F.sum((F.col(c) == "Yes").cast("long")), F.lit(0).cast("long"))
    write_csv(flat.observe(counts, F.count(F.lit(1)).alias("total"), right("top1_result").alias("top1_correct"), right("top5_result").alias("top5_correct")), f"{path}/results", "top1_result")
    names = ("total", "top1_correct", "top5_correct")
    one = rows.sparkSession.createDataFrame([tuple(counts.get[n] for n in names)], ", ".join(f"{n} long" for n in names))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"), 4)).otherwise(0.0)
    summary = one.select("*", share("top1_correct").alias("top1_accuracy"), share("top5_correct").alias("top5_accuracy"))
    write_json(summary.coalesce(1), f"{path}/summary")
    return summary


def write_json(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").json(path)


def write_boxes(boxes: DataFrame, path: str) -> None:
    write_csv(boxes, path, "page")


def page_summary(lines: DataFrame, words: DataFrame) -> DataFrame:
    """page, lines, words: counts, pages with either."""
    a, b = lines.groupBy("page").agg(F.count("*").alias("lines")), words.groupBy("page").agg(F.count("*").alias("words"))
    return a.join(b, "page", "full_outer").na.fill(0, ["lines", "words"])


#: Items of a label in one file of a batch.
ITEMS_A_FILE = 1_000_000


def labelled_items(spark: SparkSession, path: str) -> DataFrame:
    """What append_labelled has written: path, label, batch, sequence_no; without rows where nothing is."""
    schema = "path string, sequence_no long, label string, batch string"
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def append_labelled(items: DataFrame, path: str, batch: str) -> None:
    """Adds a batch of items (path, label) to a labelled dataset, a folder a label and batch, with a sequence_no that
    numbers on within the label from what other batches have. Folders are put in place when all tasks are done, so a lost
    task leaves nothing behind; a batch that is written again takes its own folders' place, with the same numbers as long
    as no other batch was written in between."""
    others = labelled_items(items.sparkSession, path).where(F.col("batch") != batch)
    greatest = kept(others.groupBy("label").agg(F.max("sequence_no").alias("sequence_no")), "greatest")
    numbered = datasets.sequence_numbers(items.select("path", "label"), greatest).withColumn("batch", F.lit(batch))
    by_file = numbered.repartition("label", F.floor(F.col("sequence_no") / ITEMS_A_FILE))
    by_file.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("label", "batch").parquet(path)


def write_manifest(crops: DataFrame, path: str) -> None:
    write_csv(crops.select("image_file", "label", "page", "line", "word_position", "x1", "y1", "x2", "y2", "source_image", "transcript"), path)


def write_transcripts(batches: DataFrame, path: str) -> DataFrame:
    """Writes transcript_text, stripped and with one closing line break (the writer's own), to a folder a batch, and
    returns batches with saved_location. A null text is an empty one. Folders are listed and put in place by the driver,
    some milliseconds each: for chosen batches that other programs read; a corpus goes to save_transcripts."""
    _transcripts(batches).withColumnRenamed("text", "value").write.mode("overwrite").partitionBy("batch_id").option("lineSep", "\n").text(path)
    return batches.withColumn("saved_location", F.concat(F.lit(f"{path}/batch_id="), F.col("batch_id")))


def save_transcripts(batches: DataFrame, path: str) -> DataFrame:
    """As write_transcripts, but as a table with a whole transcript a row, in a file a task, so that the number of files
    does not follow the number of batches. saved_location is the table and, behind #, the batch's key in it; rows that
    share a batch_id, or lack one, stay rows of their own."""
    _transcripts(batches).withColumn("text", F.concat("text", F.lit("\n"))).write.mode("overwrite").parquet(path)
    return batches.withColumn("saved_location", F.concat(F.lit(f"{path}#"), F.col("batch_id")))


def _transcripts(batches: DataFrame) -> DataFrame:
    return batches.select("batch_id", trim_spaces(F.coalesce("transcript_text", F.lit(""))).alias("text"))


def split_summary_document(summary: DataFrame, sources: DataFrame) -> DataFrame:
    """One row with the maps label_counts and per_class, for a JSON file. summary: label, total, train, val, test;
    sources: source, label, n. Maps are as long as the vocabulary."""
    per_class = F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", F.struct("total", "train", "val", "test").alias("sizes")))))
    counts = sources.groupBy("label").agg(F.sum("n").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "n")))).alias("label_counts"))
    return summary.agg(per_class.alias("per_class")).withColumn("label_counts", counts.scalar())


def write_label_list(labels: DataFrame, path: str) -> None:
    """One file, a label a line, in order of label_index: the order is the content, and a vocabulary is small."""
    labels.orderBy("label_index").coalesce(1).select(F.col("label").alias("value")).write.mode("overwrite").text(path)


def write_export(lines: DataFrame, path: str) -> None:
    """Page and line table of exported transcripts: batch_id, page_no, line_no, text; sorted, in ranges, so a batch of very
    many pages is not one file."""
    order = ["batch_id", "page_no", "line_no"]
    lines.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path)
