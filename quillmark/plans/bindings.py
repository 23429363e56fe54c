"""Given tables as the library's tables. Each is a projection; batch and page keys come from the rows themselves."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import clean_words
from ..operators import recognition, transcripts


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# Records: orders and lineitem ------------------------------------------------------------------------------------
def batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").cast("string").alias("batch_id"), F.col("o_orderkey").alias("id"), F.concat_ws(" ", "o_orderpriority", "o_custkey").alias("title"),
        F.col("o_orderdate").alias("created_at"), (F.col("o_orderstatus") == "F").alias("is_deleted"), F.lit("pending").alias("upload_status"), F.lit("").alias("transcript_text"),
    )


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page_id numbers an order's lines in a total order, below 1000 times its key."""
    order = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate")
    return table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 1000 + F.row_number().over(order)).alias("page_id"), F.col("l_orderkey").cast("string").alias("batch_id"), F.col("l_linenumber").alias("page_number"),
        F.concat(F.lit("raw "), F.col("l_partkey")).alias("raw_text"), F.when(F.col("l_linestatus") == "O", "").otherwise(F.concat(F.lit("edited "), F.col("l_partkey"))).alias("edited_text"),
        F.round(F.col("l_quantity") * 2, 2).alias("confidence"), F.col("l_linenumber").alias("rows_detected"), F.col("l_quantity").cast("int").alias("words_detected"),
        F.round(F.col("l_discount") * 100).cast("int").alias("low_confidence_words"), F.lit(False).alias("is_edited"), (F.col("l_returnflag") == "R").alias("is_deleted"),
    )


def metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    cust = F.col("o_custkey").cast("string")
    case_no = F.when(F.col("o_custkey") % 50 == 0, "0000").when(F.col("o_orderkey") % 3 == 0, F.concat(F.lit("#"), cust)).when(F.col("o_orderkey") % 3 == 1, F.concat(cust, F.lit("-"))).otherwise(cust)
    return table(spark, sf_dir, "orders").where("o_orderkey % 4 <> 3").select(
        F.col("o_orderkey").cast("string").alias("batch_id"), case_no.alias("criminal_case_no"), F.when(F.col("o_orderkey") % 5 == 0, "").otherwise(F.col("o_orderpriority")).alias("hearing_period"),
        F.concat(F.lit(" Reporter "), cust).alias("court_stenographer"), F.when(F.col("o_orderkey") % 2 == 0, "").otherwise(F.concat(F.lit("Certifier "), cust)).alias("certifier_name"), F.col("o_orderdate").alias("updated_at"),
    )


BATCHES_SQL = """batches AS (SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, o_orderkey AS id, o_orderpriority || ' ' || o_custkey AS title, o_orderdate AS created_at,
  o_orderstatus = 'F' AS is_deleted, 'pending' AS upload_status, '' AS transcript_text FROM orders)"""
PAGES_SQL = """pg AS (SELECT l_orderkey * 1000 + row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS page_id,
  CAST(l_orderkey AS VARCHAR) AS batch_id, l_linenumber::BIGINT AS page_number, 'raw ' || l_partkey AS raw_text, CASE WHEN l_linestatus = 'O' THEN '' ELSE 'edited ' || l_partkey END AS edited_text,
  round(l_quantity * 2, 2) AS confidence, l_linenumber::BIGINT AS rows_detected, CAST(l_quantity AS BIGINT) AS words_detected, CAST(round(l_discount * 100) AS BIGINT) AS low_confidence_words, false AS is_edited, l_returnflag = 'R' AS is_deleted FROM lineitem)"""
METADATA_SQL = """meta AS (SELECT CAST(o_orderkey AS VARCHAR) AS batch_id, CASE WHEN o_custkey % 50 = 0 THEN '0000' WHEN o_orderkey % 3 = 0 THEN '#' || o_custkey WHEN o_orderkey % 3 = 1 THEN o_custkey || '-' ELSE CAST(o_custkey AS VARCHAR) END AS criminal_case_no,
  CASE WHEN o_orderkey % 5 = 0 THEN '' ELSE o_orderpriority END AS hearing_period, ' Reporter ' || o_custkey AS court_stenographer, CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'Certifier ' || o_custkey END AS certifier_name, o_orderdate AS updated_at FROM orders WHERE o_orderkey % 4 <> 3)"""


# Scores: embeddings ----------------------------------------------------------------------------------------------
def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", "embedding", F.concat(F.lit("class_"), F.col("label")).alias("label"))


def scored_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector as a word with its five best classes: page, line_index, word_index, vec_id, true_label, top5."""
    every = vectors(spark, sf_dir)
    model = recognition.fit_prototypes(every.where("vec_id % 10 < 7"))
    scores = recognition.score(every, lambda: model, key="vec_id", features=["embedding"])
    ranked = every.select("vec_id", "label").join(scores, "vec_id").withColumn("top5", recognition.rank_scores(F.col("scores"), F.lit(model.names)))
    return ranked.select(
        F.floor(F.col("vec_id") / 50).alias("page"), (F.floor(F.col("vec_id") / 5) % 10 + 1).alias("line_index"), (F.col("vec_id") % 5 + 1).alias("word_index"), "vec_id", F.col("label").alias("true_label"),
        F.transform("top5", lambda c: F.struct(c["label"].alias("label"), F.round(c["confidence"], 4).alias("confidence"))).alias("top5"),
    )


def words(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = F.try_element_at("top5", F.lit(1))
    return scored_words(spark, sf_dir).withColumn("text", top["label"]).withColumn("confidence", top["confidence"])


#: Best five classes of each vector as rows vec_id, label, confidence, r.
SCORES_SQL = """vectors AS (SELECT vec_id, embedding, 'class_' || label AS label FROM embeddings),
long AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS d FROM vectors),
proto AS (SELECT label, d, avg(x) AS m FROM long WHERE vec_id % 10 < 7 GROUP BY ALL),
dots AS (SELECT l.vec_id, p.label, round(sum(l.x * p.m), 9) * 100 AS raw FROM long l JOIN proto p USING (d) GROUP BY l.vec_id, p.label),
shifted AS (SELECT vec_id, label, exp(raw - max(raw) OVER (PARTITION BY vec_id)) AS e FROM dots),
soft AS (SELECT vec_id, label, e / sum(e) OVER (PARTITION BY vec_id) AS s FROM shifted),
best AS (SELECT vec_id, label, round(s * 100, 4) AS confidence, row_number() OVER (PARTITION BY vec_id ORDER BY s DESC, label) AS r FROM soft QUALIFY r <= 5),
words AS (SELECT v.vec_id, v.vec_id // 50 AS page, (v.vec_id // 5) % 10 + 1 AS line_index, v.vec_id % 5 + 1 AS word_index, v.label AS true_label, b.label AS text, b.confidence
  FROM vectors v JOIN best b ON v.vec_id = b.vec_id AND b.r = 1)"""


# Text: documents and conversations -------------------------------------------------------------------------------
def texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, dealt out by their ids: a file of one row group is read by a single task, which would then do all work on
    its texts as well."""
    return table(spark, sf_dir, "documents").select("doc_id", "text").repartition("doc_id")


def text_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts.number_lines(texts(spark, sf_dir))


def guarded(expression: str) -> str:
    """SQL: letters and digits beyond ASCII between underscores, as word borders of the oracle's engine know ASCII only."""
    return rf"regexp_replace(regexp_replace({expression}, '([^\x00-\x7F])', '_\1_', 'g'), '_([^\x00-\x7F\p{{L}}\p{{M}}\p{{N}}\p{{Pc}}])_', '\1', 'g')"


def unguarded(expression: str) -> str:
    return rf"regexp_replace({expression}, '_([^\x00-\x7F])_', '\1', 'g')"


TEXTS_SQL = """texts AS (SELECT doc_id, text FROM documents),
raw_lines AS (SELECT doc_id, string_split(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '^\\s+|\\s+$', '', 'g'), chr(10)) AS parts FROM texts),
cut AS (SELECT doc_id, unnest(parts) AS raw, generate_subscripts(parts, 1) AS n FROM raw_lines),
trimmed AS (SELECT doc_id, n, regexp_replace(raw, '^\\s+|\\s+$', '', 'g') AS line FROM cut),
lines AS (SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY n) AS line_no, line FROM trimmed WHERE line <> '' AND NOT regexp_matches(line, '(?i)^\\s*page\\s+([a-z]+|\\d+)\\s*$'))"""


# Raster: embeddings as 8 x 8 pages -------------------------------------------------------------------------------
def raster(spark: SparkSession, sf_dir: str) -> DataFrame:
    """page, y, x, value, and grey (0 to 255)."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("i", "v"))
    value = F.col("v").cast("double")
    grey = F.least(F.greatest(F.floor((value + 0.5) * 255), F.lit(0)), F.lit(255)).cast("int")
    return cells.select("page", F.floor(F.col("i") / 8).cast("int").alias("y"), (F.col("i") % 8).alias("x"), value.alias("value"), grey.alias("grey"))


def raster_ink(spark: SparkSession, sf_dir: str) -> DataFrame:
    cells = raster(spark, sf_dir)
    low = cells.groupBy("page").agg(F.percentile("value", F.lit(0.25)).alias("cut"))
    return cells.join(low, "page").where("value < cut").select("page", "y", "x")


RASTER_SQL = """cells AS (SELECT vec_id AS page, unnest(embedding)::DOUBLE AS value, generate_subscripts(embedding, 1) - 1 AS i FROM embeddings),
pixels AS (SELECT page, i // 8 AS y, i % 8 AS x, value, least(greatest(floor((value + 0.5) * 255), 0), 255)::BIGINT AS grey FROM cells),
low AS (SELECT page, quantile_cont(value, 0.25) AS cut FROM pixels GROUP BY page),
ink AS (SELECT p.page, y, x FROM pixels p JOIN low USING (page) WHERE value < cut),
ys AS (SELECT unnest(range(8)) AS y),
profile AS (SELECT p.page, ys.y, count(i.x) AS v FROM (SELECT DISTINCT page FROM ink) p JOIN ys ON true LEFT JOIN ink i ON i.page = p.page AND i.y = ys.y GROUP BY ALL)"""


def raster_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Boxes of a page made of four values of its vector each: page, x, y, w, h, area, ink."""
    cells = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("page"), F.explode(F.sequence(F.lit(0), F.lit(15))).alias("k"), "embedding")
    part = lambda j, size: F.floor((F.element_at("embedding", (F.col("k") * 4 + j + 1).cast("int")).cast("double") + 0.5) * size).cast("int")
    boxes = cells.select("page", "k", F.greatest(part(0, 1000), F.lit(0)).alias("x"), F.greatest(part(1, 1000), F.lit(0)).alias("y"), F.greatest(part(2, 80), F.lit(1)).alias("w"), F.greatest(part(3, 60), F.lit(1)).alias("h"))
    return boxes.withColumn("area", F.floor(F.col("w") * F.col("h") / 3).cast("int"))


BOXES_SQL = """ks AS (SELECT unnest(range(16)) AS k),
quads AS (SELECT vec_id AS page, k, embedding[k*4+1]::DOUBLE AS a, embedding[k*4+2]::DOUBLE AS b, embedding[k*4+3]::DOUBLE AS c, embedding[k*4+4]::DOUBLE AS d FROM embeddings JOIN ks ON true),
boxes AS (SELECT page, k, greatest(floor((a + 0.5) * 1000)::BIGINT, 0) AS x, greatest(floor((b + 0.5) * 1000)::BIGINT, 0) AS y, greatest(floor((c + 0.5) * 80)::BIGINT, 1) AS w, greatest(floor((d + 0.5) * 60)::BIGINT, 1) AS h FROM quads),
comps AS (SELECT *, (w * h) // 3 AS area FROM boxes)"""


# Vocabulary and datasets: part, benchmark ------------------------------------------------------------------------
def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    source = F.element_at(F.create_map(*[F.lit(v) for kv in SOURCES.items() for v in kv]), F.col("p_type"))
    return table(spark, sf_dir, "part").select(
        F.concat(F.col("p_brand"), F.lit("/"), F.col("p_name"), F.lit("_"), F.lpad(F.col("p_partkey").cast("string"), 6, "0"), F.lit(".png")).alias("path"), F.col("p_brand").alias("label"), F.coalesce(source, F.lit("other")).alias("source"), "p_size", "p_partkey"
    )


SOURCES = {"ECONOMY": "clean", "STANDARD": "handwritten", "PROMO": "demo", "MEDIUM": "rpi", "LARGE": "v53"}
ITEMS_SQL = """items AS (SELECT p_brand || '/' || p_name || '_' || lpad(CAST(p_partkey AS VARCHAR), 6, '0') || '.png' AS path, p_brand AS label,
  CASE p_type WHEN 'ECONOMY' THEN 'clean' WHEN 'STANDARD' THEN 'handwritten' WHEN 'PROMO' THEN 'demo' WHEN 'MEDIUM' THEN 'rpi' WHEN 'LARGE' THEN 'v53' ELSE 'other' END AS source, p_size, p_partkey FROM part)"""


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """label: words and pairs of neighbouring words of the benchmark."""
    lists = table(spark, sf_dir, "benchmark").select(clean_words(F.col("text")).alias("w"))
    pairs = F.zip_with(F.slice("w", F.lit(1), F.greatest(F.size("w") - 1, F.lit(0))), F.slice("w", F.lit(2), F.greatest(F.size("w") - 1, F.lit(0))), lambda a, b: F.concat_ws("_", a, b))
    return lists.select(F.explode(F.concat("w", pairs)).alias("label")).distinct()


VOCABULARY_SQL = """bw AS (SELECT item_id, list_filter(list_transform(string_split(lower(regexp_replace(text, '[^A-Za-z0-9_'']+', ' ', 'g')), ' '), lambda x: trim(x, '''')), lambda x: x <> '') AS w FROM benchmark),
vocab AS (SELECT DISTINCT label FROM (SELECT unnest(w) AS label FROM bw UNION ALL SELECT unnest(list_transform(range(1, len(w)), lambda i: w[i] || '_' || w[i+1])) AS label FROM bw)),
lw AS (SELECT doc_id, line_no, list_filter(list_transform(string_split(lower(regexp_replace(line, '[^A-Za-z0-9_'']+', ' ', 'g')), ' '), lambda x: trim(x, '''')), lambda x: x <> '') AS w FROM lines)"""
