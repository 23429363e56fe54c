"""Scores of words to ranked candidates, review flags, page roll-ups and text."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources import files

# Fixed values ---------------------------------------------------------------------------------------------------
WORD_REVIEW = 55.0
CLOSE_GAP = 8.0
RERANK_BELOW = 68.0
RERANK_LEAD = 6
COMMON_WORDS = (
    "a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "he", "her", "his", "i", "in", "is", "it", "of", "on",
    "or", "she", "that", "the", "their", "they", "this", "to", "was", "we", "were", "with", "you", "your",
)
COURT_WORDS = ("accused", "case", "court", "evidence", "judge", "justice", "law", "name", "officer", "question", "record", "statement", "testified", "testimony", "witness")
# -----------------------------------------------------------------------------------------------------------------


def display_label(label: Column) -> Column:
    return F.translate(label, "_", " ")


def rank_scores(scores: Column, labels: Column, k: int = 5) -> Column:
    """array<struct<label, confidence>>: the k best of a score vector in per cent, ties to the lower index; an index
    beyond the labels is called class_<index>. Within the row: no shuffle."""
    order = F.slice(F.array_sort(F.transform(scores, lambda s, i: F.struct((-s).alias("n"), i.alias("i")))), 1, k)
    name = lambda i: F.coalesce(F.try_element_at(labels, i + 1), F.concat(F.lit("class_"), i.cast("string")))
    return F.transform(order, lambda c: F.struct(name(c["i"]).alias("label"), (-c["n"] * 100).alias("confidence")))


def low_confidence(confidence: Column) -> Column:
    return confidence < WORD_REVIEW


def review_reason(confidence: Column) -> Column:
    """'low confidence NN%' or ''."""
    return F.when(low_confidence(confidence), F.concat(F.lit("low confidence "), F.round(confidence).cast("int").cast("string"), F.lit("%"))).otherwise("")


def top_gap(top: Column) -> Column:
    """Confidence of the first candidate less that of the second; null if there is one only."""
    return F.try_element_at(top, F.lit(1))["confidence"] - F.try_element_at(top, F.lit(2))["confidence"]


def extended_reason(top: Column, confidence: Column, by_context: Column | None = None, context_reason: Column | None = None) -> Column:
    """All reasons to review a word, joined by '; '."""
    by_context = F.lit(False) if by_context is None else by_context
    context_reason = F.lit(None).cast("string") if context_reason is None else context_reason
    return F.concat_ws(
        "; ",
        F.nullif(review_reason(confidence), F.lit("")),
        F.when(F.abs(top_gap(top)) <= CLOSE_GAP, "close Top-5 candidates"),
        F.when(by_context, F.coalesce(F.nullif(context_reason, F.lit("")), F.lit("context-selected candidate"))),
    )


def top_display(top: Column) -> Column:
    """'label (cc.cc%)' of the candidates, joined by '; '."""
    return F.array_join(F.transform(top, lambda c: F.format_string("%s (%.2f%%)", c["label"], c["confidence"])), "; ")


def crop_noise(prefix: str = "") -> Column:
    """Why a crop is no word, or ''. Columns: ink_area, ink_w, ink_h, box_w, box_h, components (of usable size)."""
    # The limits and messages below.
    c = lambda n: F.col(prefix + n)
    density = c("ink_area") / F.greatest(F.lit(1), c("ink_w") * c("ink_h"))
    tiny = (c("ink_w") <= 12) & (c("ink_h") <= 12) & (c("ink_area") <= 70)
    dot = (c("ink_w") <= 18) & (c("ink_h") <= 22) & (c("ink_area") <= 130) & (c("components") <= 2)
    cross = (c("box_w") <= 42) & (c("box_h") <= 42) & (c("ink_w") <= 28) & (c("ink_h") <= 28) & (c("ink_area") <= 180) & (c("components") <= 2) & (density <= 0.45)
    empty = (c("box_w") <= 0) | (c("box_h") <= 0)
    return F.when(empty, "empty crop").when(c("ink_area") < 8, "almost no ink").when(tiny, "tiny dot-like mark").when(dot, "small punctuation-like mark").when(cross, "small x/extra-like mark").otherwise("")


def page_scores(words: DataFrame, pages: DataFrame | None = None) -> DataFrame:
    """page: confidence (0 without words), rows_detected, words_detected, low_confidence_words; for all of pages."""
    sums = words.groupBy("page").agg(
        F.avg("confidence").alias("confidence"), F.countDistinct("line_index").alias("rows_detected"), F.count("*").alias("words_detected"), F.count_if(low_confidence(F.col("confidence"))).alias("low_confidence_words")
    )
    if pages is None:
        return sums
    zero = {"confidence": 0.0, "rows_detected": 0, "words_detected": 0, "low_confidence_words": 0}
    return pages.select("page").distinct().join(sums, "page", "left").select("page", *[F.coalesce(c, F.lit(z)).alias(c) for c, z in zero.items()])


def line_texts(words: DataFrame) -> DataFrame:
    """page, line_index, line_text: words in order joined by spaces; empty words and lines are left out."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("word_index", "text"))), lambda w: w["text"])
    return words.where(F.coalesce("text", F.lit("")) != "").groupBy("page", "line_index").agg(F.array_join(ordered, " ").alias("line_text"))


def page_texts(words: DataFrame) -> DataFrame:
    """page, page_text: its lines in order, one below the other."""
    ordered = F.transform(F.array_sort(F.collect_list(F.struct("line_index", "line_text"))), lambda w: w["line_text"])
    return line_texts(words).groupBy("page").agg(F.array_join(ordered, "\n").alias("page_text"))


def run_texts(predictions: DataFrame, order: list[str], key: str = "page") -> DataFrame:
    """key, text, mean_confidence: a new line wherever the line differs from the row before."""
    place = Window.partitionBy(key).orderBy(*order)
    new = (F.coalesce(F.lag("line_index").over(place), F.lit(-1)) != F.col("line_index")).cast("int")
    marked = predictions.withColumn("_n", F.row_number().over(place)).withColumn("_new", new)
    piece = lambda w: F.concat(F.when(w["_n"] == 1, "").when(w["_new"] == 1, "\n").otherwise(" "), w["text"])
    rows = F.array_sort(F.collect_list(F.struct("_n", "_new", "text")))
    return marked.groupBy(key).agg(F.array_join(F.transform(rows, piece), "").alias("text"), F.avg("confidence").alias("mean_confidence"))


def overlay_labels(boxes: DataFrame, predictions: DataFrame) -> DataFrame:
    """Word boxes with the predicted text, or W<word_index> where there is none."""
    keys = ["page", "line_index", "word_index"]
    joined = boxes.join(predictions.select(*keys, "text"), keys, "left")
    return joined.withColumn("label", F.coalesce(F.nullif(F.col("text"), F.lit("")), F.concat(F.lit("W"), F.col("word_index").cast("string")))).drop("text")


def context_score(candidate: Column, previous: Column) -> Column:
    """How well a candidate suits the word before it (null or '' if there is none)."""
    word, before = F.lower(display_label(candidate)), F.lower(display_label(F.coalesce(previous, F.lit(""))))
    points = lambda when, n: F.when(when, n).otherwise(0)
    # The points and words below.
    return (
        points(word.isin(*COMMON_WORDS), 4) + points(word.isin(*COURT_WORDS), 6) + points((F.length(word) == 1) & ~word.isin("a", "i"), -5)
        + points(before.isin("the", "a", "an") & word.isin(*COURT_WORDS), 3) + points(before.isin("mr", "mrs", "ms", "dr"), 2)
    )


def rerank(words: DataFrame) -> DataFrame:
    """page, line_index, word_index, chosen, confidence, by_context: per line in order, a close candidate that suits
    the chosen word before it much better takes the place of an unsure first. words: page, line_index, word_index, top5."""
    lines = words.groupBy("page", "line_index").agg(F.array_sort(F.collect_list(F.struct("word_index", "top5"))).alias("row"))
    empty = F.array().cast("array<struct<word_index:bigint,chosen:string,confidence:double,by_context:boolean>>")

    def choose(state: Column, word: Column) -> Column:
        before = F.coalesce(F.try_element_at(state, F.lit(-1))["chosen"], F.lit(""))
        first = F.try_element_at(word["top5"], F.lit(1))
        base = context_score(first["label"], before)
        better = F.filter(F.slice(word["top5"], 2, 4), lambda c: (first["confidence"] - c["confidence"] <= CLOSE_GAP) & (context_score(c["label"], before) >= base + RERANK_LEAD))
        take = (first["confidence"] <= RERANK_BELOW) & (F.size(better) > 0)
        picked = F.when(take, F.try_element_at(better, F.lit(1))).otherwise(first)
        entry = F.struct(word["word_index"].cast("long").alias("word_index"), F.coalesce(picked["label"], F.lit("")).alias("chosen"), F.coalesce(picked["confidence"], F.lit(0.0)).alias("confidence"), F.coalesce(take, F.lit(False)).alias("by_context"))
        return F.concat(state, F.array(entry))

    return lines.select("page", "line_index", F.explode(F.aggregate("row", empty, choose)).alias("w")).select("page", "line_index", "w.*")


# Scorers ---------------------------------------------------------------------------------------------------------
Scorer = Callable[[pd.DataFrame], "pd.Series"]


def score(items: DataFrame, load: Callable[[], Scorer], *, key: str, features: list[str]) -> DataFrame:
    """key, scores array<double>, error: a scorer loaded once a task and fed Arrow batches. If a batch fails its
    halves are scored apart, and so on; a row that fails alone has the message in `error` and no scores; the job goes on."""
    schema = f"{items.select(key).schema.simpleString()[7:-1].replace(':', ' ')}, scores array<double>, error string"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        scorer = load()

        def attempt(rows: pd.DataFrame) -> list[tuple]:
            try:
                scores = list(scorer(rows))
                if len(scores) != len(rows):
                    raise ValueError(f"{len(scores)} scores of {len(rows)} rows")
                return [(s, None) for s in scores]
            except Exception as e:  # noqa: BLE001  becomes the row's error
                if len(rows) == 1:
                    return [(None, f"{type(e).__name__}: {e}"[:500])]
                half = len(rows) // 2
                return attempt(rows.iloc[:half]) + attempt(rows.iloc[half:])

        for batch in batches:
            pairs = attempt(batch[features]) if len(batch) else []
            yield pd.DataFrame({key: batch[key], "scores": [s for s, _ in pairs], "error": [e for _, e in pairs]})

    return items.select(key, *features).mapInPandas(run, schema)


def prototypes(train: DataFrame, label: str = "label", vector: str = "embedding") -> DataFrame:
    """label, prototype: the mean vector of each class."""
    long = train.select(label, F.posexplode(vector).alias("d", "x")).groupBy(label, "d").agg(F.avg("x").alias("m"))
    return long.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("d", "m"))), lambda s: s["m"]).alias("prototype"))


#: Bound on the numbers of a prototype matrix, which travels with each task: 400 MB.
MAX_PROTOTYPE_VALUES = 50_000_000


class PrototypeModel:
    """Class names in order and a matrix of their prototypes; softmax over inner products. A scorer's `load` is
    `lambda: model`."""

    def __init__(self, names: list[str], matrix: np.ndarray, sharpness: float = 100.0):
        self.names, self.matrix, self.sharpness = names, matrix, sharpness

    def __call__(self, features: pd.DataFrame) -> pd.Series:
        vectors = np.stack(features.iloc[:, 0].to_numpy()).astype(float)
        raw = np.round(vectors @ self.matrix.T, 9) * self.sharpness
        odds = np.exp(raw - raw.max(axis=1, keepdims=True))
        return pd.Series(list(odds / odds.sum(axis=1, keepdims=True)))


def fit_prototypes(train: DataFrame, label: str = "label", vector: str = "embedding") -> PrototypeModel:
    """The model of mean vectors."""
    return _collected(prototypes(train, label, vector).withColumnRenamed(label, "label"), F.col("label"))


def first_saved_model(spark: SparkSession, candidates: Sequence[tuple[str, str]]) -> PrototypeModel:
    """The first model, in the order given, of which both the table (label, prototype) and the label list exist. Classes
    have the list's order; labels without a prototype are an error, prototypes without a label are left out."""
    for table, labels in candidates:
        try:
            classes, listed = spark.read.parquet(table), files.label_list(spark, labels)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            continue
        missing = listed.join(classes, "label", "left_anti").select("label").head(5)
        if missing:
            raise ValueError(f"labels without a prototype in {table}: {[r['label'] for r in missing]}")
        return _collected(classes.join(listed, "label"), F.col("label_index"))
    raise FileNotFoundError(f"no model with its labels among {[table for table, _ in candidates]}")


def _collected(classes: DataFrame, order: Column) -> PrototypeModel:
    """Only the prototypes come to the driver, and only if their number is in bounds."""
    size = classes.agg(F.coalesce(F.sum(F.size("prototype")), F.lit(0))).first()[0]
    if size > MAX_PROTOTYPE_VALUES:
        raise ValueError(f"{size} prototype values are more than {MAX_PROTOTYPE_VALUES}")
    rows = classes.orderBy(order).collect()
    return PrototypeModel([r["label"] for r in rows], np.array([r["prototype"] for r in rows], float))
