"""Reports on a classifier's predictions: remarks, accuracies, confusions, log loss."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import kept

#: Fixed value: probabilities are clipped here before the logarithm.
EPSILON = 1e-7
#: Parts that the rows of a key with more than a range of rows are dealt to in a join.
SPREAD = 64


def remarks(true: Column, predicted: Column, error: Column | None = None, known: Column | None = None) -> Column:
    error, known = F.lit(None).cast("string") if error is None else error, F.lit(True) if known is None else known
    return (
        F.when(error.isNotNull(), F.concat(F.lit("Error: "), error)).when(~known, "Label not present in the vocabulary")
        .when(true == predicted, "Correct").otherwise(F.concat(F.lit("Misclassified as "), predicted))
    )


def report(predictions: DataFrame) -> DataFrame:
    """Adds row_no (from 1, in order of lower(image_file)), top1_result, top5_result (Yes or No) and remarks.
    predictions: image_file, true_label, predicted_label, top5 array<string>, error, known.

    Rows are numbered by ranges of names: see number_rows.
    """
    rows = predictions.withColumn("_key", F.lower("image_file"))
    yes = lambda c: F.when(F.coalesce(c, F.lit(False)), "Yes").otherwise("No")
    made = rows.select(
        "*", yes(F.col("known") & F.col("error").isNull() & (F.col("true_label") == F.col("predicted_label"))).alias("top1_result"),
        yes(F.col("known") & F.col("error").isNull() & F.array_contains("top5", F.col("true_label"))).alias("top5_result"),
        remarks(F.col("true_label"), F.col("predicted_label"), F.col("error"), F.col("known")).alias("remarks"),
    )
    return number_rows(made, ["_key", "image_file"]).drop("_key")


#: Rows of a range when rows are numbered, unless said otherwise.
ROWS_A_RANGE = 1_000_000
_PLACES = (1 << 33) - 1


def in_ranges(rows: DataFrame, order: list[str], rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """The rows sorted into ranges of about rows_a_range rows each, with _place: the range's number (from 0) in its upper
    bits, from the 33rd, and the row's place there (from 0) in the lower ones. Equal rows of the order are told apart by a
    hash of the whole row and by where they were, so a key of very many rows is cut into ranges like any other. The rows
    are written once, as borders come from samples that another evaluation would not draw again."""
    n = max(1, -(-rows.count() // rows_a_range))
    hashed = [c for c, t in rows.dtypes if "map<" not in t]
    tied = rows.withColumns({"_tie": F.xxhash64(*hashed), "_was": F.monotonically_increasing_id()})
    by = [*order, "_tie", "_was"]
    dealt = tied.repartitionByRange(n, *by).sortWithinPartitions(*by).withColumn("_place", F.monotonically_increasing_id())
    return kept(dealt.drop("_tie", "_was"), "ranges")


def number_rows(rows: DataFrame, order: list[str], name: str = "row_no", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Numbers rows from 1 in a total order without gathering them in one task: rows are sorted in ranges, as many as
    their number asks for, and the totals of the ranges before are added. Rows that are equal in the order are numbered in
    the order of a hash of the row."""
    placed = in_ranges(rows, order, rows_a_range)
    span = F.shiftright("_place", 33)
    counts = placed.groupBy(span.alias("_range")).agg(F.count("*").alias("_c"))
    starts = counts.select("_range", (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_start"))  # a row a range
    own = F.col("_place").bitwiseAND(F.lit(_PLACES)) + 1
    return placed.withColumn("_range", span).join(F.broadcast(starts), "_range").withColumn(name, own + F.col("_start")).drop("_range", "_start", "_place")


def number_hashed(rows: DataFrame, order: list[str], name: str = "row_no", rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """As number_rows, for an order whose first column is a hash, a long or binary: its first two bytes deal the rows out
    evenly and in order, so that no borders are sampled and nothing but their counts is written. Rows are evaluated twice,
    which has to give the same rows. A first column that is no hash (other types, or very many rows with the same two
    bytes) is numbered by number_rows."""
    key, kind = order[0], dict(rows.dtypes)[order[0]]
    if kind not in ("bigint", "binary"):
        return number_rows(rows, order, name, rows_a_range)
    dealt = rows.withColumn("_range", F.shiftright(key, 48) if kind == "bigint" else F.substring(key, 1, 2))
    counts = kept(dealt.groupBy("_range").agg(F.count("*").alias("_c")), "counts")
    total, largest = counts.agg(F.sum("_c"), F.max("_c")).first()
    if (largest or 0) > rows_a_range:
        return number_rows(rows, order, name, rows_a_range)
    if (parts := -(-(total or 0) // rows_a_range)) > int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")):
        dealt = dealt.repartition(parts, "_range")
    # Rows that are equal in the order and in all other columns can't be told apart, whichever comes first.
    others = [F.xxhash64(*c) for c in [[c for c, t in rows.dtypes if c not in order and "map<" not in t]] if c]
    place = F.row_number().over(Window.partitionBy("_range").orderBy(*order, *others))
    starts = counts.select(F.col("_range").alias("_of"), (F.sum("_c").over(Window.orderBy("_range")) - F.col("_c")).alias("_start"))  # 65,537 rows at most
    numbered = dealt.withColumn("_place", place).join(F.broadcast(starts), F.col("_range").eqNullSafe(F.col("_of")))
    return numbered.withColumn(name, F.col("_place") + F.col("_start")).drop("_range", "_of", "_start", "_place")


def number_within(rows: DataFrame, keys: list[str], order: list[str], name: str, rows_a_range: int = ROWS_A_RANGE) -> DataFrame:
    """Numbers the rows of each key from 1. Rows are numbered over all keys first, so no key is gathered in one task; the
    first number of each key is then taken off."""
    every = number_rows(rows, [*keys, *order], "_all", rows_a_range)
    # What rows of a key bring along is one row a range: the smallest number is found there first.
    firsts = every.groupBy(*keys).agg((F.min("_all") - 1).alias("_before"), F.count("*").alias("_size"))
    hot = firsts.where(F.col("_size") > rows_a_range)
    spread = F.pmod(F.col("_all"), F.lit(SPREAD))
    parts = F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1)))
    same = lambda a, b: [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in keys]
    marked = every.alias("a").join(F.broadcast(hot.select(*keys, F.lit(True).alias("_hot"))).alias("b"), same("a", "b"), "left").select("a.*", F.when(F.col("_hot"), spread).otherwise(0).alias("_part"))
    dealt = firsts.withColumn("_part", F.lit(0)).where(F.col("_size") <= rows_a_range).unionByName(hot.withColumn("_part", parts))
    joined = marked.alias("a").join(dealt.alias("b"), [*same("a", "b"), F.col("a._part") == F.col("b._part")])
    return joined.select("a.*", "_before").withColumn(name, F.col("_all") - F.col("_before")).drop("_all", "_before", "_part")


def with_unknown(evaluated: DataFrame, unknown: DataFrame) -> DataFrame:
    """Evaluated rows and rows of unknown label, whose predictions are null."""
    return evaluated.withColumn("known", F.lit(True)).unionByName(unknown.withColumn("known", F.lit(False)), allowMissingColumns=True)


def accuracies(rows: DataFrame, *, denominator: str) -> DataFrame:
    """One row: total, top1_correct, top5_correct, top1_accuracy, top5_accuracy (per cent; 0 without rows).
    denominator: 'without_errors' leaves rows with an error out, 'all' counts every row and takes unknown labels as
    wrong, 'known' leaves unknown labels out."""
    counted = {"without_errors": F.col("error").isNull(), "all": F.lit(True), "known": F.col("known")}[denominator]
    right1, right5 = F.count_if(F.col("top1_result") == "Yes"), F.count_if(F.col("top5_result") == "Yes")
    sums = rows.where(counted).agg(F.count("*").alias("total"), right1.alias("top1_correct"), right5.alias("top5_correct"))
    share = lambda c: F.when(F.col("total") > 0, F.round(F.col(c) * 100.0 / F.col("total"), 4)).otherwise(0.0)
    return sums.select("*", share("top1_correct").alias("top1_accuracy"), share("top5_correct").alias("top5_accuracy"))


def error_counts(rows: DataFrame) -> DataFrame:
    """true_label, errors, first_row of labels with errors."""
    wrong = rows.where((F.col("top1_result") == "No") & F.col("error").isNull() & F.col("known"))
    return wrong.groupBy("true_label").agg(F.count("*").alias("errors"), F.min("row_no").alias("first_row"))


def most_misclassified(rows: DataFrame, n: int = 10) -> DataFrame:
    """The n labels with the most errors, first seen first among equals."""
    return error_counts(rows).orderBy(F.desc("errors"), "first_row").limit(n)


def confusions(rows: DataFrame) -> DataFrame:
    return rows.where((F.col("true_label") != F.col("predicted_label")) & F.col("known")).groupBy("true_label", "predicted_label").agg(F.count("*").alias("n"))


def missing_pairs(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """Chosen (true_label, predicted_label) pairs that no row of the report shows."""
    return chosen.join(rows.select("true_label", "predicted_label").distinct(), ["true_label", "predicted_label"], "left_anti")


def require_pairs(chosen: DataFrame, rows: DataFrame) -> DataFrame:
    """chosen, with an error when evaluated if a pair is missing from the report."""
    gone = missing_pairs(chosen, rows).agg(F.count("*").alias("n"))
    return chosen.withColumn("_n", gone.scalar()).where(F.when(F.col("_n") > 0, F.raise_error(F.concat(F.col("_n").cast("string"), F.lit(" pairs are not in the report")))).isNull()).drop("_n")


def log_loss(rows: DataFrame) -> DataFrame:
    """One row: rows, log_loss: the mean of -ln p_true over rows with a p_true."""
    return rows.where("p_true is not null").agg(F.count("*").alias("rows"), F.round(F.avg(-F.log(F.least(F.greatest("p_true", F.lit(EPSILON)), F.lit(1 - EPSILON)))), 4).alias("log_loss"))
