"""Scans of page images, labelled folders, label lists, transcripts, boxes, crops and reports.

Listings read paths only: the bytes of images are pruned from the scan. Page and row numbers follow the path. A listing
is any table with a path: what Spark lists of a folder, or an inventory of a store that is too large to be listed by one
driver (images_in, labelled_by_stem and crops_in take either).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .. import schemas

#: Extensions of page images.
IMAGE_EXTENSIONS = ("png", "jpg", "jpeg", "bmp", "webp", "tif", "tiff")
PIXELS_AT_ONCE = 1 << 20


def _listing(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")


def _name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)$", 1)


def _folder(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]+)/[^/]+$", 1)


def _is_image(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1)).isin(*IMAGE_EXTENSIONS)


def images_in(listing: DataFrame) -> DataFrame:
    """The images of a listing, with page_number: from 1 in each folder, in order of path. Null paths are no images."""
    images = listing.where(_is_image(F.col("path")))
    return images.withColumn("page_number", F.row_number().over(Window.partitionBy(F.regexp_extract("path", r"^(.*)/[^/]+$", 1)).orderBy("path")))


def page_images(spark: SparkSession, path: str) -> DataFrame:
    """path, length, page_number (in order of path) of the images of a folder, or of one file."""
    return images_in(_listing(spark, path))


def page_pixels(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(pixels page, y, x, value as grey; paths that no decoder of the JVM reads). Each pixel is a row, made from the
    image's bytes a million at a time in the task that decoded it."""
    images = spark.read.format("image").option("dropInvalid", "false").load(path).select("image.*")

    def explode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page, width, channels, data in zip(*(batch[c] for c in ("page", "width", "nChannels", "data")), strict=True):
                wide, n = width.as_py(), channels.as_py()
                planes = np.frombuffer(data.as_py(), np.uint8).reshape(-1, n)
                for at in range(0, len(planes), PIXELS_AT_ONCE):
                    part = planes[at : at + PIXELS_AT_ONCE].astype(float)
                    # Channels lie as blue, green, red.
                    grey = part[:, 0] if n == 1 else np.floor(np.round(part[:, 0] * 0.114 + part[:, 1] * 0.587 + part[:, 2] * 0.299, 9) + 0.5)
                    i = np.arange(at, at + len(part))
                    yield pa.RecordBatch.from_arrays([pa.array([page.as_py()] * len(part), pa.string()), pa.array(i // wide), pa.array((i % wide).astype(np.int32)), pa.array(grey.astype(np.int32))], ["page", "y", "x", "value"])

    good = images.where("width > 0").select(F.col("origin").alias("page"), "width", "nChannels", "data")
    return good.mapInArrow(explode, "page string, y long, x int, value int"), images.where("width <= 0").select(F.col("origin").alias("path"))


def class_folders(spark: SparkSession, path: str, *hidden: str) -> DataFrame:
    """path, label (the parent folder). Spark's listing passes over folders that begin with _; those that are to be
    read all the same are named in `hidden`."""
    found = _listing(spark, path)
    for folder in hidden:
        found = found.unionByName(_listing(spark, folder))
    return found.where(_is_image(F.col("path"))).select("path", _folder(F.col("path")).alias("label"))


def flat_files(spark: SparkSession, path: str, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, label by file stem) of known labels, and the files of unknown ones."""
    return labelled_by_stem(_listing(spark, path), labels)


def labelled_by_stem(listing: DataFrame, labels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(path, label) of a listing's images whose file stem is one of the labels, and of those whose stem is not."""
    items = listing.where(_is_image(F.col("path"))).select("path", F.regexp_replace(_name(F.col("path")), r"\.[^.]*$", "").alias("label"))
    return items.join(labels.select("label"), "label", "left_semi"), items.join(labels.select("label"), "label", "left_anti")


def label_list(spark: SparkSession, path: str) -> DataFrame:
    """label_index (from 0, blank lines not counted), label of a text file with a label a line."""
    lines = F.filter(F.transform(F.split("value", r"\r\n|\r|\n"), lambda s: F.trim(s)), lambda s: s != "")
    return spark.read.text(path, wholetext=True).select(F.posexplode(lines).alias("label_index", "label"))


def expected_lines(spark: SparkSession, path: str) -> DataFrame:
    """page, line (from 1), text of a JSON transcript."""
    pages = spark.read.schema(schemas.EXPECTED).json(path, multiLine=True).select(F.explode("pages").alias("p"))
    return pages.select("p.page", F.posexplode("p.lines").alias("line", "text")).withColumn("line", F.col("line") + 1)


def transcript_objects(objects: DataFrame, column: str, *keys: str) -> DataFrame:
    """keys, page, line (from 1), text, broken of a column with a JSON transcript a row. An object that does not parse is
    one row with the object in `broken` and no page; null objects give nothing."""
    schema = schemas.EXPECTED.simpleString()[7:-1].replace(":", " ", 1) + ", broken string"
    parsed = objects.where(F.col(column).isNotNull()).select(*keys, F.from_json(column, schema, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "broken"}).alias("o"))
    lines = parsed.where("o.broken IS NULL").select(*keys, F.explode("o.pages").alias("p")).select(*keys, "p.page", F.posexplode("p.lines").alias("line", "text"))
    good = lines.withColumn("line", F.col("line") + 1).withColumn("broken", F.lit(None).cast("string"))
    return good.unionByName(parsed.where("o.broken IS NOT NULL").select(*keys, "o.broken"), allowMissingColumns=True)


def labelled_lines(spark: SparkSession, path: str, folders: str = "*") -> DataFrame:
    """label, value: the lines of text files in folders label=<label> below path. The label is parsed from each file's
    path, and only folders of labels that match the pattern (as they are written) are listed at all."""
    # The path comes as a URI, and labels were escaped when their folders were named.
    decode = lambda c: F.url_decode(F.replace(c, F.lit("+"), F.lit("%2B")))
    label = decode(decode(F.regexp_extract(F.col("_metadata.file_path"), r"/label=([^/]+)/[^/]+$", 1)))
    rows = spark.read.option("recursiveFileLookup", "true").text(f"{path}/label={folders}")
    return rows.select(label.alias("label"), "value")


def line_boxes(spark: SparkSession, path: str) -> DataFrame:
    """page (from the folder Page_<n>), line_index, x, y, w, h of CSV files; rows that don't parse are dropped."""
    rows = spark.read.schema(schemas.LINE_BOXES).option("header", "true").option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.csv").csv(path)
    page = F.nullif(F.regexp_extract(F.col("_metadata.file_path"), r"Page_(\d+)", 1), F.lit("")).cast("int")
    return rows.select(page.alias("page"), *schemas.LINE_BOXES.names)


def word_crops(spark: SparkSession, path: str) -> DataFrame:
    """path, page, line, word of crop files named line_<n>_word_<n> below folders Page_<n>; other names are dropped."""
    return crops_in(_listing(spark, path))


def crops_in(listing: DataFrame) -> DataFrame:
    """path, page, line, word of a listing's crops, as word_crops; page is null where no folder names one."""
    number = lambda pattern: F.regexp_extract("path", pattern, 1)
    crops = listing.where(F.col("path").rlike(r"line_\d+_word_\d+"))
    return crops.select("path", F.nullif(number(r"Page_(\d+)"), F.lit("")).cast("int").alias("page"), number(r"line_(\d+)_word_").cast("int").alias("line"), number(r"_word_(\d+)").cast("int").alias("word"))


def prediction_report(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.PREDICTIONS).option("header", "true").csv(path)


def expected_with_boxes(expected: DataFrame, boxes: DataFrame) -> DataFrame:
    """Expected lines with the box of the same page and line, if there is one."""
    return expected.join(boxes.withColumnRenamed("line_index", "line"), ["page", "line"], "left")


def first_sources(listing: DataFrame, n: int = 7) -> DataFrame:
    return listing.orderBy("path").limit(n)


def transcript_files(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, text: transcript files in folders batch_id=<id>, each read whole."""
    return spark.read.schema("text string, batch_id string").text(path, wholetext=True).select("batch_id", "text")


def saved_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """batch_id, text: the table of transcripts that sinks.save_transcripts writes."""
    return spark.read.schema("batch_id string, text string").parquet(path)


def record_store(spark: SparkSession, path: str, name: str) -> DataFrame:
    """A table of the record store with its declared schema; missing columns of older files are null."""
    schema = {"batches": schemas.BATCHES, "pages": schemas.PAGES}.get(name)
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    return reader.parquet(f"{path}/{name}")
