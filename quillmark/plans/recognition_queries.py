"""Recognition and evaluation queries over scored words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import evaluation, recognition
from . import bindings as b
from .registry import query

S = b.SCORES_SQL
LISTS = {"common": ", ".join(f"'{w}'" for w in recognition.COMMON_WORDS), "court": ", ".join(f"'{w}'" for w in recognition.COURT_WORDS)}


class _FailsOnSome:
    """A scorer that cannot read every thirteenth vector, so that a batch with one of them fails."""

    def __init__(self, model: recognition.PrototypeModel):
        self.model = model

    def __call__(self, features):
        if (features["number"] % 13 == 5).any():
            raise ValueError("unreadable")
        return self.model(features[["embedding"]])


@query("SELECT vec_id, CASE WHEN vec_id % 13 = 5 THEN 'ValueError: unreadable' ELSE '' END AS error, CASE WHEN vec_id % 13 = 5 THEN '' ELSE text END AS text FROM words", S)
def isolated_failures(spark: SparkSession, d: str) -> DataFrame:
    """Vectors that the scorer fails on become rows with an error and no text, whatever shares their batch."""
    every = b.vectors(spark, d)
    model = recognition.fit_prototypes(every.where("vec_id % 10 < 7"))
    scored = recognition.score(every.withColumn("number", F.col("vec_id")), lambda: _FailsOnSome(model), key="vec_id", features=["number", "embedding"])
    best = F.try_element_at(recognition.rank_scores(F.col("scores"), F.lit(model.names)), F.lit(1))["label"]
    return scored.select("vec_id", F.coalesce("error", F.lit("")).alias("error"), F.coalesce(F.when(F.col("scores").isNotNull(), best), F.lit("")).alias("text"))


@query("SELECT vec_id, r AS rank, label, confidence FROM best", S)
def top_candidates(spark: SparkSession, d: str) -> DataFrame:
    """U02, W01."""
    return b.scored_words(spark, d).select("vec_id", F.posexplode("top5").alias("p", "c")).select("vec_id", (F.col("p") + 1).cast("long").alias("rank"), "c.label", "c.confidence")


@query("SELECT vec_id, replace(text, '_', ' ') AS shown, confidence < 55 AS needs_review, CASE WHEN confidence < 55 THEN 'low confidence ' || round(confidence)::BIGINT || '%' ELSE '' END AS reason FROM words", S)
def word_review(spark: SparkSession, d: str) -> DataFrame:
    """F05, F06."""
    c = F.col("confidence")
    return b.words(spark, d).select("vec_id", recognition.display_label(F.col("text")).alias("shown"), recognition.low_confidence(c).alias("needs_review"), recognition.review_reason(c).alias("reason"))


@query(
    """SELECT w.vec_id, round(w.confidence - s.confidence, 4) AS gap, concat_ws('; ', CASE WHEN w.confidence < 55 THEN 'low confidence ' || round(w.confidence)::BIGINT || '%' END, CASE WHEN abs(w.confidence - s.confidence) <= 8 THEN 'close Top-5 candidates' END) AS reasons
    FROM words w JOIN best s ON s.vec_id = w.vec_id AND s.r = 2""", S,
)
def extended_review(spark: SparkSession, d: str) -> DataFrame:
    """F07, W16."""
    return b.words(spark, d).select("vec_id", F.round(recognition.top_gap(F.col("top5")), 4).alias("gap"), recognition.extended_reason(F.col("top5"), F.col("confidence")).alias("reasons"))


@query("SELECT page, round(avg(confidence), 4) AS confidence, count(DISTINCT line_index) AS rows_detected, count(*) AS words_detected, count(*) FILTER (confidence < 55) AS low_confidence_words FROM words GROUP BY page", S)
def page_scores(spark: SparkSession, d: str) -> DataFrame:
    """A01, A02."""
    words = b.words(spark, d)
    return recognition.page_scores(words, words.select("page")).withColumn("confidence", F.round("confidence", 4))


TEXT_SQL = """line_text AS (SELECT page, line_index, string_agg(text, ' ' ORDER BY word_index) AS t FROM words GROUP BY ALL)"""


@query("SELECT page, string_agg(t, chr(10) ORDER BY line_index) AS page_text FROM line_text GROUP BY page", S, TEXT_SQL)
def page_texts(spark: SparkSession, d: str) -> DataFrame:
    """A04."""
    return recognition.page_texts(b.words(spark, d))


@query("SELECT w.page, t.text, round(avg(confidence), 4) AS mean_confidence FROM words w JOIN (SELECT page, string_agg(t, chr(10) ORDER BY line_index) AS text FROM line_text GROUP BY page) t USING (page) GROUP BY ALL", S, TEXT_SQL)
def run_texts(spark: SparkSession, d: str) -> DataFrame:
    """T30."""
    return recognition.run_texts(b.words(spark, d), ["line_index", "word_index"]).withColumn("mean_confidence", F.round("mean_confidence", 4))


@query("SELECT vec_id, CASE WHEN vec_id % 3 = 0 THEN 'W' || word_index ELSE text END AS label FROM words", S)
def overlay_labels(spark: SparkSession, d: str) -> DataFrame:
    """J05."""
    words = b.words(spark, d)
    return recognition.overlay_labels(words.select("page", "line_index", "word_index", "vec_id"), words.where("vec_id % 3 <> 0")).select("vec_id", "label")


@query("SELECT vec_id, string_agg(label || ' (' || confidence::DECIMAL(10, 2) || '%)', '; ' ORDER BY r) AS shown FROM (SELECT vec_id, label, r, round(confidence, 1) AS confidence FROM best) GROUP BY vec_id", S)
def top_display(spark: SparkSession, d: str) -> DataFrame:
    """T27."""
    rounded = F.transform("top5", lambda c: F.struct(c["label"].alias("label"), F.round(c["confidence"], 1).alias("confidence")))
    return b.scored_words(spark, d).select("vec_id", recognition.top_display(rounded).alias("shown"))


CONTEXT_SQL = f"""tokens AS (SELECT conv_id, turn, unnest(string_split(lower(text), ' ')) AS w, generate_subscripts(string_split(lower(text), ' '), 1) AS i FROM conversations),
pairs AS (SELECT conv_id, turn, i, w, coalesce(lag(w) OVER (PARTITION BY conv_id, turn ORDER BY i), '') AS p FROM tokens),
points AS (SELECT conv_id, turn, CASE WHEN w IN ({LISTS["common"]}) THEN 4 ELSE 0 END + CASE WHEN w IN ({LISTS["court"]}) THEN 6 ELSE 0 END - CASE WHEN length(w) = 1 AND w NOT IN ('a', 'i') THEN 5 ELSE 0 END
  + CASE WHEN p IN ('the', 'a', 'an') AND w IN ({LISTS["court"]}) THEN 3 ELSE 0 END + CASE WHEN p IN ('mr', 'mrs', 'ms', 'dr') THEN 2 ELSE 0 END AS s FROM pairs)"""


@query("SELECT conv_id, turn, sum(s)::BIGINT AS score FROM points GROUP BY ALL", CONTEXT_SQL)
def context_scores(spark: SparkSession, d: str) -> DataFrame:
    """T28."""
    words = b.table(spark, d, "conversations").select("conv_id", "turn", F.posexplode(F.split(F.lower("text"), " ")).alias("i", "w"))
    before = F.lag("w").over(Window.partitionBy("conv_id", "turn").orderBy("i"))
    return words.withColumn("s", recognition.context_score(F.col("w"), before)).groupBy("conv_id", "turn").agg(F.sum("s").alias("score"))


#: Words that stand for the classes by number, so that candidates suit the word before them more or less.
CLASS_WORDS = ("the", "court", "x", "mr", "judge", "a", "smith", "evidence", "zone", "of")


def _points_sql(word: str, before: str) -> str:
    return f"""(CASE WHEN {word} IN ({LISTS["common"]}) THEN 4 ELSE 0 END + CASE WHEN {word} IN ({LISTS["court"]}) THEN 6 ELSE 0 END - CASE WHEN length({word}) = 1 AND {word} NOT IN ('a', 'i') THEN 5 ELSE 0 END
      + CASE WHEN {before} IN ('the', 'a', 'an') AND {word} IN ({LISTS["court"]}) THEN 3 ELSE 0 END + CASE WHEN {before} IN ('mr', 'mrs', 'ms', 'dr') THEN 2 ELSE 0 END)"""


@query(
    f"""SELECT page, line_index, word_index, chosen, confidence, by_context FROM (
      WITH RECURSIVE candidates AS (SELECT w.page, w.line_index, w.word_index, b.r, b.confidence, {list(CLASS_WORDS)}[replace(b.label, 'class_', '')::BIGINT % {len(CLASS_WORDS)} + 1] AS label FROM best b JOIN words w USING (vec_id)),
      tops AS (SELECT page, line_index, word_index, list(struct_pack(label := label, confidence := confidence) ORDER BY r) AS top FROM candidates GROUP BY ALL),
      ordered AS (SELECT *, row_number() OVER (PARTITION BY page, line_index ORDER BY word_index) AS n FROM tops),
      step AS (SELECT page, line_index, word_index, n - 1 AS n, '' AS chosen, 0::DOUBLE AS confidence, false AS by_context FROM ordered WHERE n = 1 UNION ALL
        SELECT page, line_index, word_index, n, CASE WHEN take THEN better[1].label ELSE top[1].label END, CASE WHEN take THEN better[1].confidence ELSE top[1].confidence END, take FROM (
          SELECT *, top[1].confidence <= 68 AND len(better) > 0 AS take FROM (
            SELECT o.*, list_filter(o.top[2:5], lambda c: o.top[1].confidence - c.confidence <= 8 AND {_points_sql("c.label", "s.chosen")} >= {_points_sql("o.top[1].label", "s.chosen")} + 6) AS better
            FROM step s JOIN ordered o ON o.page = s.page AND o.line_index = s.line_index AND o.n = s.n + 1)))
      SELECT * FROM step WHERE n > 0)""", S,
)
def reranked_words(spark: SparkSession, d: str) -> DataFrame:
    """T29."""
    number = lambda c: F.translate(c["label"], "clas_", "").cast("int") % len(CLASS_WORDS)
    word = lambda c: F.get(F.lit(list(CLASS_WORDS)), number(c))
    words = b.scored_words(spark, d).withColumn("top5", F.transform("top5", lambda c: F.struct(word(c).alias("label"), c["confidence"].alias("confidence"))))
    return recognition.rerank(words)


# Evaluation ------------------------------------------------------------------------------------------------------
REPORT_SQL = """held AS (SELECT *, 'img_' || lpad(CAST(vec_id AS VARCHAR), 8, '0') || '.png' AS image_file FROM words WHERE vec_id % 10 >= 7),
judged AS (SELECT h.*, CASE WHEN vec_id % 40 = 7 THEN 'ValueError: unreadable' END AS error, true_label <> 'class_9' AS known,
  EXISTS (SELECT 1 FROM best b WHERE b.vec_id = h.vec_id AND b.label = h.true_label) AS in5 FROM held h),
report AS (SELECT *, row_number() OVER (ORDER BY lower(image_file)) AS row_no, CASE WHEN known AND error IS NULL AND true_label = text THEN 'Yes' ELSE 'No' END AS top1_result, CASE WHEN known AND error IS NULL AND in5 THEN 'Yes' ELSE 'No' END AS top5_result,
  CASE WHEN error IS NOT NULL THEN 'Error: ' || error WHEN NOT known THEN 'Label not present in the vocabulary' WHEN true_label = text THEN 'Correct' ELSE 'Misclassified as ' || text END AS remarks FROM judged)"""


def report_rows(spark: SparkSession, d: str) -> DataFrame:
    """The report on the held-out vectors."""
    rows = b.words(spark, d).where("vec_id % 10 >= 7").select(
        F.concat(F.lit("img_"), F.lpad(F.col("vec_id").cast("string"), 8, "0"), F.lit(".png")).alias("image_file"), "vec_id", "true_label", F.col("text").alias("predicted_label"), F.transform("top5", lambda c: c["label"]).alias("top5"),
        F.when(F.col("vec_id") % 40 == 7, "ValueError: unreadable").alias("error"),
    )
    unknown = F.col("true_label") == "class_9"
    both = evaluation.with_unknown(rows.where(~unknown), rows.where(unknown))
    return evaluation.report(both)


@query("SELECT row_no, image_file, true_label, text AS predicted_label, top1_result, top5_result, remarks FROM report", S, REPORT_SQL)
def prediction_report(spark: SparkSession, d: str) -> DataFrame:
    """D03, X06, W18, O05."""
    return report_rows(spark, d).select("row_no", "image_file", "true_label", "predicted_label", "top1_result", "top5_result", "remarks")


def _accuracy_sql(where: str) -> str:
    return f"""SELECT count(*) AS total, count(*) FILTER (top1_result = 'Yes') AS top1_correct, count(*) FILTER (top5_result = 'Yes') AS top5_correct,
    CASE WHEN count(*) > 0 THEN round(count(*) FILTER (top1_result = 'Yes') * 100.0::DOUBLE / count(*), 4) ELSE 0 END AS top1_accuracy, CASE WHEN count(*) > 0 THEN round(count(*) FILTER (top5_result = 'Yes') * 100.0::DOUBLE / count(*), 4) ELSE 0 END AS top5_accuracy FROM report WHERE {where}"""


@query(_accuracy_sql("error IS NULL"), S, REPORT_SQL)
def accuracy_without_errors(spark: SparkSession, d: str) -> DataFrame:
    """A06."""
    return evaluation.accuracies(report_rows(spark, d), denominator="without_errors")


@query(_accuracy_sql("true"), S, REPORT_SQL)
def accuracy_of_all(spark: SparkSession, d: str) -> DataFrame:
    """A06."""
    return evaluation.accuracies(report_rows(spark, d), denominator="all")


@query(_accuracy_sql("known"), S, REPORT_SQL)
def accuracy_of_known(spark: SparkSession, d: str) -> DataFrame:
    """A06."""
    return evaluation.accuracies(report_rows(spark, d), denominator="known")


@query("SELECT true_label, count(*) AS errors, min(row_no) AS first_row FROM report WHERE top1_result = 'No' AND error IS NULL AND known GROUP BY 1 ORDER BY 2 DESC, 3 LIMIT 10", S, REPORT_SQL)
def most_misclassified(spark: SparkSession, d: str) -> DataFrame:
    """A07, A10, O03."""
    return evaluation.most_misclassified(report_rows(spark, d))


@query("SELECT true_label, text AS predicted_label, count(*) AS n FROM report WHERE true_label <> text AND known GROUP BY ALL", S, REPORT_SQL)
def confusions(spark: SparkSession, d: str) -> DataFrame:
    """A08."""
    return evaluation.confusions(report_rows(spark, d))


@query(
    """SELECT label AS true_label, 'class_' || (substr(label, 7)::BIGINT + n) % 10 AS predicted_label FROM (SELECT DISTINCT label FROM vectors), (SELECT unnest([1, 2, 3]) AS n)
    WHERE NOT EXISTS (SELECT 1 FROM report r WHERE r.true_label = label AND r.text = 'class_' || (substr(label, 7)::BIGINT + n) % 10)""", S, REPORT_SQL,
)
def missing_confusions(spark: SparkSession, d: str) -> DataFrame:
    """J13."""
    number = F.substring("true_label", 7, 10).cast("int")
    labels = b.vectors(spark, d).select(F.col("label").alias("true_label")).distinct().withColumn("n", F.explode(F.array(F.lit(1), F.lit(2), F.lit(3))))
    chosen = labels.select("true_label", F.concat(F.lit("class_"), (number + F.col("n")) % 10).alias("predicted_label"))
    return evaluation.missing_pairs(chosen, report_rows(spark, d))


@query("SELECT count(*) AS rows, round(avg(-ln(least(greatest(s, 1e-7), 1 - 1e-7))), 4) AS log_loss FROM soft JOIN vectors USING (vec_id, label) WHERE vec_id % 10 >= 7", S)
def log_loss(spark: SparkSession, d: str) -> DataFrame:
    """A09."""
    every = b.vectors(spark, d)
    model = recognition.fit_prototypes(every.where("vec_id % 10 < 7"))
    held = every.where("vec_id % 10 >= 7")
    scored = recognition.score(held, lambda: model, key="vec_id", features=["embedding"]).join(held.select("vec_id", "label"), "vec_id")
    return evaluation.log_loss(scored.withColumn("p_true", F.try_element_at("scores", F.array_position(F.lit(model.names), F.col("label")).cast("int"))))
