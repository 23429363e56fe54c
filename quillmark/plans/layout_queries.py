"""Layout queries over small rasters and boxes made from vectors, and bands of events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import layout, recognition
from . import bindings as b
from .registry import query

R, X = b.RASTER_SQL, b.BOXES_SQL
WIDTH, HEIGHT = 1000, 1000


def _profile(spark: SparkSession, d: str) -> DataFrame:
    return layout.profile(b.raster_ink(spark, d), size=8)


@query("SELECT page, y, v FROM profile", R)
def ink_profile(spark: SparkSession, d: str) -> DataFrame:
    """A17."""
    return _profile(spark, d)


@query("SELECT page, round(median(value), 6) AS median, round(stddev_pop(value), 6) AS std, round(quantile_cont(value, 0.04), 6) AS low FROM pixels GROUP BY page", R)
def intensity_statistics(spark: SparkSession, d: str) -> DataFrame:
    """A18."""
    return layout.intensity(b.raster(spark, d)).select("page", F.round("median", 6).alias("median"), F.round("std", 6).alias("std"), F.round("low_percentile", 6).alias("low"))


OTSU_SQL = """bins AS (SELECT page, grey AS g, count(*) AS n FROM pixels GROUP BY ALL),
sums AS (SELECT page, g, sum(n) OVER w AS w0, sum(n * g) OVER w AS s0, sum(n) OVER (PARTITION BY page) AS w, sum(n * g) OVER (PARTITION BY page) AS s FROM bins WINDOW w AS (PARTITION BY page ORDER BY g)),
apart AS (SELECT page, g, CASE WHEN w > w0 THEN round(w0::DOUBLE * (w - w0) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) * (s0::DOUBLE / w0 - (s - s0)::DOUBLE / (w - w0)) / (w::DOUBLE * w), 6) ELSE 0 END AS b FROM sums),
otsu AS (SELECT page, g AS otsu FROM apart QUALIFY row_number() OVER (PARTITION BY page ORDER BY b DESC, g) = 1),
stats AS (SELECT page, median(grey) AS median, stddev_pop(grey) AS std, quantile_cont(grey, 0.04) AS low FROM pixels GROUP BY page)"""


@query("SELECT page, otsu, trunc(least(greatest(least(otsu::DOUBLE, median - std * 2.5::DOUBLE, low), 105), 195)::DOUBLE) AS threshold FROM otsu JOIN stats USING (page)", R, OTSU_SQL)
def ink_thresholds(spark: SparkSession, d: str) -> DataFrame:
    """A19, A20."""
    pixels = b.raster(spark, d).select("page", F.col("grey").alias("value"))
    return layout.ink_threshold(pixels).select("page", "otsu", F.col("threshold").cast("double").alias("threshold"))


@query("SELECT page, y, round(sum(v) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE, 6) AS smoothed FROM profile", R)
def smoothed_profile(spark: SparkSession, d: str) -> DataFrame:
    """W08, box."""
    return layout.smooth_box(_profile(spark, d), 3).select("page", "y", F.round("smoothed", 6).alias("smoothed"))


#: Weights of a Gaussian of width 3 (sigma 0.8); the row before the first is the second one, and so at the end.
GAUSS_SQL = """k AS (SELECT exp(-((1 / 0.8::DOUBLE) ** 2) / 2) AS e), g AS (SELECT p.*, coalesce(lag(v) OVER w, lead(v) OVER w) AS a, coalesce(lead(v) OVER w, lag(v) OVER w) AS z FROM profile p WINDOW w AS (PARTITION BY page ORDER BY y))"""


@query("SELECT page, y, round((v + e * (a + z)) / (1 + 2 * e), 6) AS smoothed FROM g, k", R, GAUSS_SQL)
def gaussian_profile(spark: SparkSession, d: str) -> DataFrame:
    """W08, Gaussian."""
    return layout.smooth_gaussian(_profile(spark, d), 3).select("page", "y", F.round("smoothed", 6).alias("smoothed"))


BANDS_SQL = """act AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM profile WHERE v >= 2),
bands AS (SELECT page, min(y) AS top, max(y) AS bottom FROM act GROUP BY page, island),
starts AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY top) > 2 THEN 1 ELSE 0 END AS s FROM bands),
grouped AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY top) AS g FROM starts),
merged AS (SELECT page, min(top) AS top, max(bottom) AS bottom FROM grouped GROUP BY page, g)"""


def _bands(spark: SparkSession, d: str) -> DataFrame:
    return layout.active_bands(_profile(spark, d).withColumn("active", F.col("v") >= 2))


@query("SELECT page, top, bottom FROM bands", R, BANDS_SQL)
def active_bands(spark: SparkSession, d: str) -> DataFrame:
    """W09."""
    return _bands(spark, d)


@query("SELECT page, top, bottom FROM merged", R, BANDS_SQL)
def merged_bands(spark: SparkSession, d: str) -> DataFrame:
    """W10."""
    return layout.merge_bands(_bands(spark, d), 2)


@query(
    """SELECT page, top, bottom, greatest(min(x) - 1, 0) AS x, greatest(min(i.y) - 1, 0) AS y, least(max(x) + 1, 7) - greatest(min(x) - 1, 0) + 1 AS w, least(max(i.y) + 1, 7) - greatest(min(i.y) - 1, 0) + 1 AS h
    FROM merged m JOIN ink i USING (page) WHERE i.y BETWEEN top - 1 AND bottom + 1 GROUP BY ALL""", R, BANDS_SQL,
)
def band_boxes(spark: SparkSession, d: str) -> DataFrame:
    """J12."""
    return layout.band_boxes(layout.merge_bands(_bands(spark, d), 2), b.raster_ink(spark, d), 8, 8, 1, 1)


EVENT_BANDS_SQL = """hours AS (SELECT DISTINCT user_id AS page, floor(epoch(ts))::BIGINT // 3600 AS y FROM events),
isl AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM hours),
bands AS (SELECT page, min(y) AS top, max(y) AS bottom FROM isl GROUP BY page, island),
starts AS (SELECT *, CASE WHEN top - lag(bottom) OVER (PARTITION BY page ORDER BY top) > 3 THEN 1 ELSE 0 END AS s FROM bands),
grouped AS (SELECT *, sum(s) OVER (PARTITION BY page ORDER BY top) AS g FROM starts)"""


@query("SELECT page, min(top) AS top, max(bottom) AS bottom FROM grouped GROUP BY page, g", EVENT_BANDS_SQL)
def event_bands(spark: SparkSession, d: str) -> DataFrame:
    """W09, W10 over hours of events."""
    hours = b.table(spark, d, "events").select(F.col("user_id").alias("page"), F.floor(F.unix_timestamp("ts") / 3600).alias("y")).distinct().withColumn("active", F.lit(True))
    return layout.merge_bands(layout.active_bands(hours), 3)


PEAKS_SQL = """runs AS (SELECT *, sum(n) OVER (PARTITION BY page ORDER BY y) AS run FROM (SELECT *, CASE WHEN v = lag(v) OVER (PARTITION BY page ORDER BY y) THEN 0 ELSE 1 END AS n FROM profile)),
near AS (SELECT *, lag(v) OVER w AS l, lead(v) OVER w AS r FROM runs WINDOW w AS (PARTITION BY page ORDER BY y)),
first_of_run AS (SELECT page, run, min(y) AS s FROM near WHERE v >= 2 AND v >= l AND v >= r GROUP BY ALL),
peaks AS (SELECT n.page, (min(s) + max(n.y)) // 2 AS y, any_value(n.v) AS v FROM near n JOIN first_of_run f ON n.page = f.page AND n.run = f.run GROUP BY n.page, n.run),
pairs AS (SELECT page, y AS first_peak, lead(y) OVER (PARTITION BY page ORDER BY y) AS second_peak FROM peaks)"""


@query("SELECT page, y, v FROM peaks", R, PEAKS_SQL)
def profile_peaks(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    return layout.peaks(_profile(spark, d), 2)


@query(
    """SELECT page, unnest(list_reduce(list_prepend([]::STRUCT(y BIGINT, v BIGINT)[], list_transform(list(struct_pack(y := y::BIGINT, v := v::BIGINT) ORDER BY v DESC, y), lambda p: [p])),
      lambda kept, p: CASE WHEN len(list_filter(kept, lambda k: abs(k.y - p[1].y) < 3)) = 0 THEN list_concat(kept, p) ELSE kept END), recursive := true) FROM peaks GROUP BY page""", R, PEAKS_SQL,
)
def suppressed_peaks(spark: SparkSession, d: str) -> DataFrame:
    """W14 (of peaks that are less than three rows apart the highest)."""
    return layout.suppress_peaks(layout.peaks(_profile(spark, d), 2), 3)


@query("SELECT p.page, first_peak, second_peak, arg_min(f.y, f.v * 100 + f.y) AS valley FROM pairs p JOIN profile f ON f.page = p.page AND f.y BETWEEN first_peak AND second_peak WHERE second_peak IS NOT NULL GROUP BY ALL", R, PEAKS_SQL)
def profile_valleys(spark: SparkSession, d: str) -> DataFrame:
    """W14."""
    profile = _profile(spark, d)
    return layout.valleys(profile, layout.peaks(profile, 2))


# Boxes -----------------------------------------------------------------------------------------------------------
HEADER = "(y < 220 AND x + w / 2.0 BETWEEN 360 AND 640 AND w < 260 AND h < 60)"
FILTER_SQL = f"""flagged AS (SELECT page, k, {HEADER} AS header, h < 4 OR (w >= 850 AND h <= 55 AND (y < 180 OR y + h > 820)) OR (w < 180 AND h < 65 AND y < 350 AND x + w >= 920) OR (w < 80 AND h < 45 AND (x <= 25 OR x + w >= 920)) AS edge,
  w >= 35 AND h >= 8 AND area >= greatest(18.0, w * 0.015::DOUBLE) AND NOT (area / greatest(1, w * h) < 0.0035::DOUBLE AND area < 900) AND NOT {HEADER} AS peaks,
  w >= 35 AND h >= 8 AND area >= greatest(28.0, w * 0.025::DOUBLE) AND NOT (area / greatest(1, w * h) < 0.0045::DOUBLE AND area < 1200) AND NOT {HEADER} AS components FROM comps)"""


@query("SELECT * FROM flagged", X, FILTER_SQL)
def line_filters(spark: SparkSession, d: str) -> DataFrame:
    """F11, F12."""
    boxes = b.raster_boxes(spark, d).withColumn("ink", F.col("area"))
    plausible = {rule: layout.is_plausible_line(WIDTH, HEIGHT, rule=rule, min_width=35, min_height=8).alias(rule) for rule in ("peaks", "components")}
    return boxes.select("page", "k", layout.is_centered_header(WIDTH, HEIGHT).alias("header"), layout.is_edge_artifact(WIDTH, HEIGHT).alias("edge"), *plausible.values())


#: Boxes spread over a page of 20,000 rows, so that some stand alone.
TALL_SQL = """tall AS (SELECT page, k, x, y * 20 AS y, w, h FROM boxes WHERE k < 6),
gaps AS (SELECT *, lead(y) OVER w - (y + h - 1) AS gap, row_number() OVER w AS n FROM tall WINDOW w AS (PARTITION BY page ORDER BY y, x)),
lone AS (SELECT *, coalesce((y < 4800 AND x + w / 2.0 BETWEEN 250 AND 750 AND w < 580 AND h < 1300 AND gap > 500) OR (y < 3200 AND w < 180 AND h < 1000 AND gap > 400), false) AS q FROM gaps)"""


@query("SELECT page, k, x, y FROM lone l WHERE EXISTS (SELECT 1 FROM lone o WHERE o.page = l.page AND o.n <= l.n AND NOT o.q)", X, TALL_SQL)
def headers_dropped(spark: SparkSession, d: str) -> DataFrame:
    """F13."""
    tall = b.raster_boxes(spark, d).where("k < 6").withColumn("y", F.col("y") * 20)
    return layout.drop_isolated_headers(tall, WIDTH, 20 * HEIGHT).select("page", "k", "x", "y")


@query("SELECT page, k, row_number() OVER (PARTITION BY page ORDER BY y, x, k) AS line_index FROM boxes", X)
def numbered_lines(spark: SparkSession, d: str) -> DataFrame:
    """W15."""
    return layout.number_boxes(b.raster_boxes(spark, d), "y", "x", "k").select("page", "k", F.col("line_index").cast("long").alias("line_index"))


@query(
    """SELECT page, x, y, w, CASE WHEN reaches THEN greatest(y, least(y + h - 1, border)) - y + 1 ELSE h END AS h FROM (
      WITH RECURSIVE ordered AS (SELECT page, x, y, w, h, row_number() OVER (PARTITION BY page ORDER BY y, x, w, h) AS n FROM comps),
      step AS (SELECT page, x, y, w, h, n FROM ordered WHERE n = 1 UNION ALL
        SELECT page, x, top AS y, w, bottom - top + 1 AS h, n FROM (
          SELECT o.page, o.x, o.w, o.n, o.y + o.h - 1 AS bottom, CASE WHEN s.y + s.h - 1 >= o.y
            THEN least(o.y + o.h - 1, greatest(o.y, round_even((s.y + s.h / 2::DOUBLE + o.y + o.h / 2::DOUBLE) / 2, 0)::BIGINT + 1)) ELSE o.y END AS top
          FROM step s JOIN ordered o ON o.page = s.page AND o.n = s.n + 1))
      SELECT s.page, s.x, s.y, s.w, s.h, coalesce(s.y + s.h - 1 >= o.y, false) AS reaches, round_even((s.y + s.h / 2::DOUBLE + o.y + o.h / 2::DOUBLE) / 2, 0)::BIGINT AS border
      FROM step s LEFT JOIN ordered o ON o.page = s.page AND o.n = s.n + 1)""", X,
)
def separated_lines(spark: SparkSession, d: str) -> DataFrame:
    """W13."""
    return layout.separate_overlaps(b.raster_boxes(spark, d))


CROP_SQL = """crops AS (SELECT page, k, w % 35 AS ink_w, h % 35 AS ink_h, area % 200 AS ink_area, w AS box_w, h AS box_h, k % 4 AS components FROM comps)"""


@query(
    """SELECT page, k, CASE WHEN box_w <= 0 OR box_h <= 0 THEN 'empty crop' WHEN ink_area < 8 THEN 'almost no ink' WHEN ink_w <= 12 AND ink_h <= 12 AND ink_area <= 70 THEN 'tiny dot-like mark' WHEN ink_w <= 18 AND ink_h <= 22 AND ink_area <= 130 AND components <= 2 THEN 'small punctuation-like mark'
    WHEN box_w <= 42 AND box_h <= 42 AND ink_w <= 28 AND ink_h <= 28 AND ink_area <= 180 AND components <= 2 AND ink_area / greatest(1, ink_w * ink_h) <= 0.45::DOUBLE THEN 'small x/extra-like mark' ELSE '' END AS reason FROM crops""", X, CROP_SQL,
)
def crop_noise(spark: SparkSession, d: str) -> DataFrame:
    """F10."""
    crops = b.raster_boxes(spark, d).select("page", "k", (F.col("w") % 35).alias("ink_w"), (F.col("h") % 35).alias("ink_h"), (F.col("area") % 200).alias("ink_area"), F.col("w").alias("box_w"), F.col("h").alias("box_h"), (F.col("k") % 4).alias("components"))
    return crops.select("page", "k", recognition.crop_noise().alias("reason"))


@query(
    """SELECT c.page, c.k, b.k AS b_k FROM comps c JOIN boxes b ON b.page = c.page AND b.k >= 12 WHERE c.k < 12 AND c.x + c.w > b.x AND b.x + b.w > c.x AND c.y + c.h > b.y AND b.y + b.h > c.y""", X,
)
def components_in_boxes(spark: SparkSession, d: str) -> DataFrame:
    """J10."""
    boxes = b.raster_boxes(spark, d)
    return layout.components_in_boxes(boxes.where("k < 12"), boxes.where("k >= 12").drop("area")).select("page", "k", "b_k")


LINES_SQL = """lns AS (SELECT page, k AS line_index, x, y, w, h FROM boxes WHERE k >= 12),
assigned AS (SELECT c.page, c.k, c.x, c.y, c.w, c.h, c.area, l.line_index FROM comps c JOIN lns l ON l.page = c.page WHERE c.k < 12
  QUALIFY row_number() OVER (PARTITION BY c.page, c.k ORDER BY abs((l.y + l.h / 2.0) - (c.y + c.h / 2.0)), l.line_index) = 1)"""


def _assigned(spark: SparkSession, d: str) -> DataFrame:
    boxes = b.raster_boxes(spark, d)
    lines = boxes.where("k >= 12").select("page", F.col("k").alias("line_index"), "x", "y", "w", "h")
    return layout.assign_to_lines(boxes.where("k < 12"), lines)


@query("SELECT page, k, line_index FROM assigned", X, LINES_SQL)
def line_assignment(spark: SparkSession, d: str) -> DataFrame:
    """J11."""
    return _assigned(spark, d).select("page", "k", "line_index")


@query(
    """SELECT page, line_index, median(w)::DOUBLE AS median_width, median(h)::DOUBLE AS median_height, greatest(3, round_even(greatest(7.0::DOUBLE, least(34.0::DOUBLE, 60 * 0.34::DOUBLE, 900 * 0.03::DOUBLE, median(w) * 1.35::DOUBLE)), 0)::BIGINT) AS dilation,
    trunc(greatest(36.0::DOUBLE, least(90.0::DOUBLE, median(w) * 2.4::DOUBLE))) AS gap FROM assigned GROUP BY ALL""", X, LINES_SQL,
)
def line_medians(spark: SparkSession, d: str) -> DataFrame:
    """A23, A24."""
    medians = layout.component_medians(_assigned(spark, d), "page", "line_index")
    return medians.select("*", layout.dilation_width(F.col("median_width"), F.lit(900), F.lit(60)).alias("dilation"), layout.gap_threshold(F.col("median_width"), F.lit(900)).cast("double").alias("gap"))


WORDS_SQL = """reach AS (SELECT *, max(x + w) OVER (PARTITION BY page, line_index ORDER BY x, y, w, h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS r FROM assigned),
numbered AS (SELECT *, sum(CASE WHEN r IS NULL OR x - r > 21 THEN 1 ELSE 0 END) OVER (PARTITION BY page, line_index ORDER BY x, y, w, h) AS word_no FROM reach),
bounds AS (SELECT page, line_index, word_no, greatest(min(x) - 8, 0) AS x, greatest(min(y) - 4, 0) AS y, least(max(x + w - 1) + 8, 999) AS x2, least(max(y + h - 1) + 4, 999) AS y2, sum(area) AS ink FROM numbered GROUP BY ALL),
wb AS (SELECT page, line_index, x, y, x2 - x + 1 AS w, y2 - y + 1 AS h, ink::BIGINT AS ink FROM bounds WHERE x2 - x + 1 >= 4 AND y2 - y + 1 >= 4 AND ink >= greatest(4.0, (x2 - x + 1) * 0.015::DOUBLE))"""


@query("SELECT page, line_index, k, word_no::BIGINT AS word_no FROM numbered", X, LINES_SQL, WORDS_SQL)
def word_groups(spark: SparkSession, d: str) -> DataFrame:
    """W11."""
    return layout.group_words(_assigned(spark, d), F.lit(21)).select("page", "line_index", "k", "word_no")


@query("SELECT *, row_number() OVER (PARTITION BY page, line_index ORDER BY x, y) AS word_index FROM wb", X, LINES_SQL, WORDS_SQL)
def word_boxes(spark: SparkSession, d: str) -> DataFrame:
    """A21, W15."""
    pad_x, pad_y = layout.word_padding(F.lit(60))
    return layout.word_boxes(layout.group_words(_assigned(spark, d), F.lit(21)), WIDTH, HEIGHT, pad_x=pad_x, pad_y=pad_y).withColumn("word_index", F.col("word_index").cast("long"))


ISOLATED_SQL = """near AS (SELECT *, x - (lag(x) OVER w + lag(w) OVER w) AS before, lead(x) OVER w - (x + w) AS after, median(area) OVER (PARTITION BY page, line_index) AS m FROM assigned WHERE area >= 4 WINDOW w AS (PARTITION BY page, line_index ORDER BY x, w, area, y))"""


@query("SELECT page, line_index, k FROM near WHERE NOT ((before IS NULL OR before > 120) AND (after IS NULL OR after > 120) AND (before IS NOT NULL OR after IS NOT NULL) AND area < greatest(50.0, m * 0.35::DOUBLE))", X, LINES_SQL, ISOLATED_SQL)
def outliers_dropped(spark: SparkSession, d: str) -> DataFrame:
    """W12."""
    return layout.drop_isolated_components(_assigned(spark, d), F.lit(120)).select("page", "line_index", "k")


ORIENTATION_SQL = """turned AS (SELECT page, (CASE k % 3 WHEN 0 THEN 0 WHEN 1 THEN 90 ELSE 270 END)::BIGINT AS rotation, x, w * 8 AS w, h FROM boxes),
pts AS (SELECT page, rotation, CASE WHEN w / greatest(1, h) >= 2.8::DOUBLE AND w >= 80 THEN 3 + least(w / greatest(1, h), 12) * 0.3::DOUBLE + least(w / 1000, 1) * 2 + 1.5 ELSE 0 END - CASE WHEN h > w * 0.7::DOUBLE THEN 5 ELSE 0 END - CASE WHEN x <= 2 AND h >= 180 AND w >= 220 THEN 8 ELSE 0 END AS p, x <= 2 AND h >= 180 AND w >= 220 AS s FROM turned),
scores AS (SELECT page, rotation, round(sum(p::DOUBLE) - abs(count(*) - 14) * 0.15::DOUBLE, 6) AS score, count(*) >= 3 AND count(*) FILTER (s) / count(*) >= 0.35::DOUBLE AS sideways FROM pts GROUP BY ALL)"""


def _orientation(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("k") % 3
    boxes = b.raster_boxes(spark, d).select("page", F.when(k == 0, 0).when(k == 1, 90).otherwise(270).alias("rotation"), "x", "y", (F.col("w") * 8).alias("w"), "h")
    shape = boxes.select("page", "rotation").distinct().withColumn("width", F.lit(WIDTH)).withColumn("height", F.lit(HEIGHT))
    return layout.orientation(boxes, shape)


@query("SELECT * FROM scores", X, ORIENTATION_SQL)
def orientation_scores(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    return _orientation(spark, d)


@query("SELECT page, rotation FROM scores QUALIFY row_number() OVER (PARTITION BY page ORDER BY score DESC, rotation) = 1", X, ORIENTATION_SQL)
def best_rotations(spark: SparkSession, d: str) -> DataFrame:
    """A22."""
    return layout.best_rotation(_orientation(spark, d))


def _merged_sql(joins: str, order: str, extra: str = "") -> str:
    """SQL of boxes that are joined to the last one (s) in order, if a condition on it and the next box (o) holds."""
    listed = f", {extra}" if extra else ""
    return f"""SELECT page, x, y, w, h{listed} FROM (
      WITH RECURSIVE ordered AS (SELECT page, x, y, w, h{listed}, row_number() OVER (PARTITION BY page ORDER BY {order}) AS n FROM placed),
      step AS (SELECT page, n, n AS g, x, y, w, h{listed} FROM ordered WHERE n = 1 UNION ALL
        SELECT page, n, g, (u).x, (u).y, (u).w, (u).h{', (u).' + extra if extra else ''} FROM (
          SELECT o.page, o.n, CASE WHEN {joins} THEN s.g ELSE o.n END AS g,
            CASE WHEN {joins} THEN {{'x': least(s.x, o.x), 'y': least(s.y, o.y), 'w': greatest(s.x + s.w, o.x + o.w) - least(s.x, o.x), 'h': greatest(s.y + s.h, o.y + o.h) - least(s.y, o.y){f", '{extra}': s.{extra} + o.{extra}" if extra else ""}}}
            ELSE {{'x': o.x, 'y': o.y, 'w': o.w, 'h': o.h{f", '{extra}': o.{extra}" if extra else ""}}} END AS u
          FROM step s JOIN ordered o ON o.page = s.page AND o.n = s.n + 1))
      SELECT * FROM step QUALIFY row_number() OVER (PARTITION BY page, g ORDER BY n DESC) = 1)"""


#: Sixteen boxes of a page over 2,000 rows, so that some overlap, some are near and some stand alone.
PLACED_SQL = "placed AS (SELECT page, k, x, y * 2 AS y, w, h, area FROM comps)"


def _placed(spark: SparkSession, d: str) -> DataFrame:
    return b.raster_boxes(spark, d).withColumn("y", F.col("y") * 2)


@query(_merged_sql("(least(s.y + s.h - 1, o.y + o.h - 1) - greatest(s.y, o.y) + 1 > least(s.h, o.h) * 0.25::DOUBLE OR o.y - (s.y + s.h - 1) <= 8)", "y, x, w, h"), X, PLACED_SQL)
def merged_line_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Running merge of the line boxes of a page."""
    return layout.merge_line_boxes(_placed(spark, d), 2 * HEIGHT)


OVER = "least(s.{a} + s.{b}, o.{a} + o.{b}) - greatest(s.{a}, o.{a}) > least(s.{b}, o.{b}) * 0.35::DOUBLE"


@query(_merged_sql(f"({OVER.format(a='x', b='w')} AND {OVER.format(a='y', b='h')})", "x, y, w, h, area", "area"), X, "placed AS (SELECT page, k, x // 5 AS x, y // 5 AS y, w, h, area FROM comps)")
def merged_word_boxes(spark: SparkSession, d: str) -> DataFrame:
    """Running merge of the word boxes of a page, with the sum of their areas."""
    near = {c: F.floor(F.col(c) / 5) for c in "xy"}
    return layout.merge_word_boxes(b.raster_boxes(spark, d).withColumns(near))


LINE, GUARD = 3, 2
#: Vectors as profiles of 64 rows, their bands, and the bands of each level of cuts.
TALL_SQL = f"""heights AS (SELECT page, i AS y, grey AS v FROM (SELECT page, i, least(greatest(floor((value + 0.5) * 255), 0), 255)::BIGINT AS grey FROM cells)),
smooth AS (SELECT page, y, sum(v) OVER (PARTITION BY page ORDER BY y ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) / 3.0::DOUBLE AS v FROM heights),
on_rows AS (SELECT page, y, y - row_number() OVER (PARTITION BY page ORDER BY y) AS island FROM smooth WHERE v >= 110),
b0 AS (SELECT page, min(y) AS top, max(y) AS bottom FROM on_rows GROUP BY page, island),
tall AS (SELECT page, floor(greatest({LINE} * 2.0::DOUBLE, median(bottom - top + 1) * 1.65::DOUBLE)) AS tall FROM b0 GROUP BY page),
""" + ",\n".join(
    f"""v{n} AS (SELECT b.page, top, bottom, first(s.y ORDER BY s.v, s.y) AS valley FROM b{n} b JOIN tall t ON t.page = b.page JOIN smooth s ON s.page = b.page AND s.y BETWEEN top + {GUARD} AND bottom - {GUARD}
  WHERE bottom - top + 1 >= tall AND bottom - top + 1 >= {2 * LINE} AND bottom - {GUARD} > top + {GUARD} GROUP BY ALL),
c{n} AS (SELECT v.page, top, bottom, valley FROM v{n} v JOIN smooth s ON s.page = v.page AND s.y BETWEEN top AND bottom GROUP BY ALL
  HAVING least(max(v) FILTER (y < valley), max(v) FILTER (y > valley)) > 0 AND max(v) FILTER (y = valley) <= least(max(v) FILTER (y < valley), max(v) FILTER (y > valley)) * 0.88::DOUBLE
    AND valley - top >= {LINE} AND bottom - valley >= {LINE}),
b{n + 1} AS (SELECT * FROM b{n} ANTI JOIN c{n} USING (page, top, bottom) UNION ALL SELECT page, top, valley - 1 FROM c{n} UNION ALL SELECT page, valley + 1, bottom FROM c{n})"""
    for n in range(4)
)


@query("SELECT page, top, bottom FROM b4", R, TALL_SQL)
def split_bands(spark: SparkSession, d: str) -> DataFrame:
    """Tall bands cut at their valleys, and the parts again."""
    rows = b.table(spark, d, "embeddings").select(F.col("vec_id").alias("page"), F.posexplode("embedding").alias("y", "v"))
    grey = F.least(F.greatest(F.floor((F.col("v").cast("double") + 0.5) * 255), F.lit(0)), F.lit(255))
    smoothed = layout.smooth_box(rows.select("page", "y", grey.alias("v")), 3)
    bands = layout.active_bands(smoothed.withColumn("active", F.col("smoothed") >= 110))
    return layout.split_tall_bands(bands, smoothed, LINE, guard=GUARD)
