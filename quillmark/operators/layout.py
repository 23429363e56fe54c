"""Layout of pages from tables of ink: profiles, thresholds, bands, boxes of lines and words.

Tables: ink(page, y, x, value) with a row a pixel, profile(page, y, v), bands(page, top, bottom), boxes(page, x, y, w,
h), components(page, x, y, w, h, area). Every window and join has the page among its keys, so pages spread freely and
no interval join becomes a product.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import let

# Fixed values ---------------------------------------------------------------------------------------------------
OTSU_STD_FACTOR = 2.5
OTSU_LOW_PERCENTILE = 0.04
THRESHOLD_RANGE = (105, 195)
# -----------------------------------------------------------------------------------------------------------------


# Profiles and thresholds -----------------------------------------------------------------------------------------
def profile(ink: DataFrame, along: str = "y", size: int | None = None) -> DataFrame:
    """page, <along>, v: ink pixels of each row (or column), with rows without ink as 0 up to `size` (or the last)."""
    counts = ink.groupBy("page", along).agg(F.count("*").alias("v"))
    top = F.max(along) if size is None else F.lit(size - 1)
    frame = counts.groupBy("page").agg(top.alias("last")).select("page", F.explode(F.sequence(F.lit(0), F.col("last").cast("int"))).alias(along))
    return frame.join(counts, ["page", along], "left").select("page", along, F.coalesce("v", F.lit(0)).alias("v"))


def exact_percentiles(rows: DataFrame, keys: list[str], column: str, **shares: float) -> DataFrame:
    """keys and a column for each named share: the percentile of the column's values, between two values in proportion.
    Equal values are counted before anything is sorted, so a key with very many rows is held as its distinct values."""
    whole = Window.partitionBy(*keys)
    bins = rows.where(F.col(column).isNotNull()).groupBy(*keys, F.col(column).alias("_v")).agg(F.count("*").alias("_n"))
    counted = bins.select(*keys, "_v", F.sum("_n").over(whole.orderBy("_v")).alias("_upto"), F.sum("_n").over(whole).alias("_all"))
    place = lambda share: F.lit(share) * (F.col("_all") - 1)
    at = lambda i: F.min(F.when(F.col("_upto") > i, F.col("_v"))).cast("double")
    picks = {name: F.struct(at(F.floor(place(s))).alias("low"), at(F.ceil(place(s))).alias("high"), F.max(place(s) - F.floor(place(s))).alias("over")) for name, s in shares.items()}
    found = counted.groupBy(*keys).agg(*[pick.alias(name) for name, pick in picks.items()])
    return found.select(*keys, *[((1 - F.col(f"{n}.over")) * F.col(f"{n}.low") + F.col(f"{n}.over") * F.col(f"{n}.high")).alias(n) for n in shares])


def intensity(pixels: DataFrame) -> DataFrame:
    """page, median, std (of the population), low_percentile: exact."""
    spread = pixels.groupBy("page").agg(F.stddev_pop("value").alias("std"))
    return exact_percentiles(pixels, ["page"], "value", median=0.5, low_percentile=OTSU_LOW_PERCENTILE).join(spread, "page").select("page", "median", "std", "low_percentile")


def otsu(pixels: DataFrame) -> DataFrame:
    """page, otsu: the grey value that splits a page's histogram with the greatest variance between both sides (the
    smallest of equals)."""
    bins = pixels.groupBy("page", F.col("value").cast("int").alias("g")).agg(F.count("*").alias("n"))
    below = Window.partitionBy("page").orderBy("g")
    whole = Window.partitionBy("page")
    sums = bins.select("page", "g", F.sum("n").over(below).alias("w0"), F.sum(F.col("n") * F.col("g")).over(below).alias("s0"), F.sum("n").over(whole).alias("w"), F.sum(F.col("n") * F.col("g")).over(whole).alias("s"))
    w1 = F.col("w") - F.col("w0")
    apart = F.col("s0") / F.col("w0") - (F.col("s") - F.col("s0")) / F.when(w1 > 0, w1)
    between = F.coalesce(F.round(F.col("w0") * w1 * apart * apart / (F.col("w") * F.col("w")), 6), F.lit(0.0))
    return sums.withColumn("b", between).groupBy("page").agg(F.max_by("g", F.struct("b", -F.col("g"))).alias("otsu"))


def ink_threshold(pixels: DataFrame) -> DataFrame:
    """page, threshold: Otsu's value held down by the page's spread and darkest pixels, and kept in a range."""
    value = F.least(F.col("otsu").cast("double"), F.col("median") - F.col("std") * OTSU_STD_FACTOR, F.col("low_percentile"))
    low, high = THRESHOLD_RANGE
    return otsu(pixels).join(intensity(pixels), "page").select("page", "otsu", F.least(F.greatest(value, F.lit(float(low))), F.lit(float(high))).cast("int").alias("threshold"))


def smooth_box(profile_: DataFrame, width: int) -> DataFrame:
    """Adds smoothed: the mean over an odd width with zeros beyond the ends."""
    k = width // 2
    return profile_.withColumn("smoothed", F.sum("v").over(Window.partitionBy("page").orderBy("y").rowsBetween(-k, k)) / float(2 * k + 1))


def smooth_gaussian(profile_: DataFrame, width: int) -> DataFrame:
    """Adds smoothed: a Gaussian of odd width whose sigma follows from the width, the profile mirrored at its ends."""
    k, sigma = width // 2, 0.3 * ((width - 1) * 0.5 - 1) + 0.8
    weights = [math.exp(-((i / sigma) ** 2) / 2) for i in range(-k, k + 1)]
    total = sum(weights)
    # A neighbour beyond an end is the one as far inside, without the end itself.
    rows = Window.partitionBy("page").orderBy("y")
    n = F.count("*").over(Window.partitionBy("page"))
    place = F.row_number().over(rows) - 1
    out: Column = F.lit(0.0)
    for offset, weight in zip(range(-k, k + 1), weights, strict=True):
        at = F.col("_i") + offset
        mirrored = F.when(at < 0, -at).when(at >= F.col("_n"), 2 * (F.col("_n") - 1) - at).otherwise(at)
        out = out + F.element_at("_row", (F.least(F.greatest(mirrored, F.lit(0)), F.col("_n") - 1) + 1).cast("int")) * (weight / total)
    numbered = profile_.withColumn("_i", place).withColumn("_n", n)
    series = profile_.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct("y", "v"))), lambda s: s["v"].cast("double")).alias("_row"))
    return numbered.join(series, "page").withColumn("smoothed", out).drop("_i", "_n", "_row")


# Bands -----------------------------------------------------------------------------------------------------------
def active_bands(rows: DataFrame, key: str = "page", position: str = "y", active: str = "active") -> DataFrame:
    """key, top, bottom: runs of consecutive active positions."""
    on = rows.where(active).select(key, position, (F.col(position) - F.row_number().over(Window.partitionBy(key).orderBy(position))).alias("island"))
    return on.groupBy(key, "island").agg(F.min(position).alias("top"), F.max(position).alias("bottom")).drop("island")


def merge_bands(bands: DataFrame, gap: int, key: str = "page") -> DataFrame:
    """Bands whose distance from the band before is at most `gap` joined to it."""
    order = Window.partitionBy(key).orderBy("top")
    start = F.coalesce((F.col("top") - F.lag("bottom").over(order) > gap).cast("int"), F.lit(0))
    return bands.withColumn("_s", start).withColumn("_g", F.sum("_s").over(order)).groupBy(key, "_g").agg(F.min("top").alias("top"), F.max("bottom").alias("bottom")).drop("_g")


def split_tall_bands(bands: DataFrame, smoothed: DataFrame, min_height: int, *, guard: int | None = None, ratio: float = 0.88, levels: int = 4) -> DataFrame:
    """page, top, bottom: bands much taller than their page's median are cut at their deepest row, and the parts again, up
    to `levels` times. smoothed: page, y, smoothed, a row for each y of the page. A cut needs a row away from both ends
    that is at most `ratio` of the lower of the peaks beside it, and parts of min_height rows; the row itself goes. Each
    level is one expression over the page's profile, so no level shuffles; bands of pages without a profile stay."""
    guard = max(20, min_height // 2) if guard is None else guard
    # What counts as tall.
    tall = F.floor(F.greatest(F.lit(min_height * 2.0), F.median("rows") * 1.65))
    listed = bands.withColumn("rows", F.col("bottom") - F.col("top") + 1).groupBy("page").agg(tall.alias("tall"), F.collect_list(F.struct(F.col("top").cast("long").alias("top"), F.col("bottom").cast("long").alias("bottom"))).alias("parts"))
    series = smoothed.groupBy("page").agg(F.min("y").alias("first"), F.transform(F.array_sort(F.collect_list(F.struct("y", "smoothed"))), lambda s: s["smoothed"].cast("double")).alias("series"))

    def values(start: Column, end: Column) -> Column:
        return F.slice("series", F.greatest(start - F.col("first") + 1, F.lit(1)).cast("int"), F.greatest(end - start + 1, F.lit(0)).cast("int"))

    def part(start: Column, end: Column) -> Column:
        return F.struct(start.cast("long").alias("top"), end.cast("long").alias("bottom"))

    def cut(band: Column) -> Column:
        top, bottom = band["top"], band["bottom"]
        rows = bottom - top + 1
        within = values(top + guard, bottom - guard)

        def at_valley(lowest: Column) -> Column:
            valley = F.array_position(within, lowest) - 1 + top + guard
            floor = F.least(F.array_max(values(top, valley - 1)), F.array_max(values(valley + 1, bottom)))
            deep = (floor > 0) & (lowest <= floor * F.lit(ratio)) & (valley - top >= min_height) & (bottom - valley >= min_height)
            return F.when(deep, F.array(part(top, valley - 1), part(valley + 1, bottom))).otherwise(F.array(part(top, bottom)))

        wide = (rows >= F.col("tall")) & (rows >= 2 * min_height) & (bottom - guard > top + guard) & (F.size(within) > 0)
        return F.when(F.coalesce(wide, F.lit(False)), let(F.array_min(within), at_valley)).otherwise(F.array(part(top, bottom)))

    found = listed.join(series, "page", "left")
    for _ in range(levels):
        found = found.withColumn("parts", F.flatten(F.transform("parts", cut)))
    return found.select("page", F.inline("parts"))


def band_boxes(bands: DataFrame, ink: DataFrame, width: int, height: int, pad_x: int, pad_y: int) -> DataFrame:
    """page, top, bottom, x, y, w, h: the padded bounds of the ink in each padded band; bands without ink are left
    out. Ink meets a band through its row, so the join is on page and row."""
    y1, y2 = F.greatest(F.col("top") - pad_y, F.lit(0)), F.least(F.col("bottom") + pad_y, F.lit(height - 1))
    rows = bands.select("page", "top", "bottom", F.explode(F.sequence(y1.cast("int"), y2.cast("int"))).alias("y"))
    spans = ink.groupBy("page", F.col("y").cast("int").alias("y")).agg(F.min("x").alias("x1"), F.max("x").alias("x2"))
    found = rows.join(spans, ["page", "y"]).groupBy("page", "top", "bottom").agg(F.min("x1").alias("x1"), F.max("x2").alias("x2"), F.min("y").alias("b1"), F.max("y").alias("b2"))
    x, y = F.greatest(F.col("x1") - pad_x, F.lit(0)), F.greatest(F.col("b1") - pad_y, F.lit(0))
    return found.select("page", "top", "bottom", x.alias("x"), y.alias("y"), (F.least(F.col("x2") + pad_x, F.lit(width - 1)) - x + 1).alias("w"), (F.least(F.col("b2") + pad_y, F.lit(height - 1)) - y + 1).alias("h"))


def peaks(profile_: DataFrame, threshold: Column | float) -> DataFrame:
    """page, y, v: rows of at least the threshold that are no lower than their neighbours, so shoulders count too; of a
    level run its middle, counted from the first such row. The first and the last row of a page are none."""
    order = Window.partitionBy("page").orderBy("y")
    page = Window.partitionBy("page")
    runs = profile_.withColumn("_new", F.coalesce((F.col("v") != F.lag("v").over(order)).cast("int"), F.lit(1))).withColumn("_run", F.sum("_new").over(order)).withColumn("_top", F.min("y").over(page)).withColumn("_end", F.max("y").over(page))
    flat = runs.groupBy("page", "_run").agg(F.min("y").alias("a"), F.max("y").alias("b"), F.first("v").alias("v"), F.first("_top").alias("_top"), F.first("_end").alias("_end"))
    by_run = Window.partitionBy("page").orderBy("_run")
    a, b = F.col("a"), F.col("b")
    falls = (F.col("v") >= F.lead("v").over(by_run)) | (b == F.col("_end"))
    at_first = (a > F.col("_top")) & (F.col("v") > F.lag("v").over(by_run)) & ((b > a) | falls)
    at_second = (b > a) & ((b > a + 1) | falls)
    start = F.when(at_first, a).when(at_second, a + 1)
    return flat.withColumn("_s", start).where((F.col("v") >= threshold) & (F.col("_s") < F.col("_end"))).select("page", F.floor((F.col("_s") + b) / 2).alias("y"), "v")


def suppress_peaks(peaks_: DataFrame, min_distance: int) -> DataFrame:
    """Peaks of a page that are at least min_distance from every higher one that stays; of equals the first goes first."""
    best_first = F.array_sort(F.collect_list(F.struct((-F.col("v")).alias("n"), "y", "v")))
    keep = lambda kept, p: F.when(F.forall(kept, lambda k: F.abs(k["y"] - p["y"]) >= min_distance), F.array_append(kept, p)).otherwise(kept)
    rows = peaks_.groupBy("page").agg(best_first.alias("p"))
    return rows.select("page", F.explode(F.aggregate("p", F.slice("p", 1, 0), keep)).alias("k")).select("page", "k.y", "k.v")


def valleys(profile_: DataFrame, peaks_: DataFrame) -> DataFrame:
    """page, first_peak, second_peak, valley: the first lowest row between neighbouring peaks."""
    pairs = peaks_.select("page", F.col("y").alias("first_peak"), F.lead("y").over(Window.partitionBy("page").orderBy("y")).alias("second_peak")).where("second_peak is not null")
    # Rows take the last peak at or before them; a peak's own row closes the pair before it too.
    place = Window.partitionBy("page").orderBy("y").rowsBetween(Window.unboundedPreceding, 0)
    marks = profile_.join(peaks_.select("page", "y", F.lit(True).alias("_p")), ["page", "y"], "left")
    inner = marks.withColumn("first_peak", F.last(F.when(F.col("_p"), F.col("y")), ignorenulls=True).over(place)).where("first_peak is not null").select("page", "first_peak", "y", "v")
    closing = pairs.join(profile_, (pairs["page"] == profile_["page"]) & (pairs["second_peak"] == profile_["y"])).select(pairs["page"], "first_peak", "y", "v")
    lowest = inner.unionByName(closing).groupBy("page", "first_peak").agg(F.min_by("y", F.struct("v", "y")).alias("valley"))
    near = F.col("second_peak") <= F.col("first_peak") + 1
    return pairs.join(lowest, ["page", "first_peak"]).select("page", "first_peak", "second_peak", F.when(near, F.col("first_peak")).otherwise(F.col("valley")).alias("valley"))


# Line boxes ------------------------------------------------------------------------------------------------------
def number_boxes(boxes: DataFrame, *order: str) -> DataFrame:
    """line_index from 1 by (y, x), or by the given columns."""
    return boxes.withColumn("line_index", F.row_number().over(Window.partitionBy("page").orderBy(*(order or ("y", "x")))))


def is_centered_header(width: int, height: int) -> Column:
    middle = F.col("x") + F.col("w") / 2.0
    return (F.col("y") < height * 0.22) & middle.between(width * 0.36, width * 0.64) & (F.col("w") < width * 0.26) & (F.col("h") < height * 0.06)


def is_plausible_line(width: int, height: int, *, rule: str = "peaks", min_width: int | None = None, min_height: int | None = None) -> Column:
    """Whether a box (with its `ink`) is a line. rule: 'peaks', 'projection' or 'components', which differ in how
    much ink they ask for."""
    # The limits below and the defaults above.
    floor, share, density, sparse, wide, wide_sparse = {"peaks": (18, 0.015, 0.0035, 900, 0.008, 1300), "projection": (18, 0.018, 0.0, 0, 0.0, 0), "components": (28, 0.025, 0.0045, 1200, 0.009, 1500)}[rule]
    min_width = max(35, int(width * 0.025)) if min_width is None else min_width
    min_height = max(8, int(height * 0.006)) if min_height is None else min_height
    ink, dense = F.col("ink"), F.col("ink") / F.greatest(F.lit(1), F.col("w") * F.col("h"))
    thin = (dense < density) & (ink < sparse) | (F.col("w") > width * 0.65) & (dense < wide) & (ink < wide_sparse)
    return (F.col("w") >= min_width) & (F.col("h") >= min_height) & (ink >= F.greatest(F.lit(float(floor)), F.col("w") * share)) & ~thin & ~is_centered_header(width, height)


def is_edge_artifact(width: int, height: int) -> Column:
    x, y, w, h = (F.col(c) for c in "xywh")
    right, left = x + w >= width * 0.92, x <= width * 0.025
    across = (w >= width * 0.85) & (h <= height * 0.055) & ((y < height * 0.18) | (y + h > height * 0.82))
    compact = (w < width * 0.18) & (h < height * 0.065) & (y < height * 0.35) & right
    tiny = (w < width * 0.08) & (h < height * 0.045) & (left | right)
    return (h < max(4, int(height * 0.003))) | across | compact | tiny


def drop_isolated_headers(boxes: DataFrame, width: int, height: int) -> DataFrame:
    """Without the leading boxes of a page that stand alone above the next one; the last box always stays."""
    # The limits below and the defaults above.
    order = Window.partitionBy("page").orderBy("y", "x")
    gap, middle = F.lead("y").over(order) - (F.col("y") + F.col("h") - 1), F.col("x") + F.col("w") / 2.0
    alone = (F.col("y") < height * 0.24) & middle.between(width * 0.25, width * 0.75) & (F.col("w") < width * 0.58) & (F.col("h") < height * 0.065) & (F.col("_gap") > max(34, int(height * 0.025)))
    tiny = (F.col("y") < height * 0.16) & (F.col("w") < width * 0.18) & (F.col("h") < height * 0.05) & (F.col("_gap") > max(28, int(height * 0.02)))
    marked = boxes.withColumn("_gap", gap).withColumn("_q", F.coalesce(alone | tiny, F.lit(False)))
    leading = F.min(F.col("_q").cast("int")).over(order.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return marked.withColumn("_lead", leading).where(~F.col("_lead")).drop("_gap", "_q", "_lead")


def separate_overlaps(boxes: DataFrame) -> DataFrame:
    """Boxes of a page from top to bottom; where one reaches into the next both end at the middle of their centres.
    Each step sees what the step before left, so a page is a fold."""
    box = "struct<x:bigint,y:bigint,w:bigint,h:bigint>"
    rows = boxes.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("y", "x", "w", "h"))).alias("b"))

    def add(done: Column, nxt: Column) -> Column:
        last = F.try_element_at(done, F.lit(-1))
        bottom1, bottom2 = last["y"] + last["h"] - 1, nxt["y"] + nxt["h"] - 1
        border = F.bround((last["y"] + last["h"] / 2.0 + nxt["y"] + nxt["h"] / 2.0) / 2.0).cast("long")
        new1 = F.greatest(last["y"], F.least(bottom1, border))
        top2 = F.least(bottom2, F.greatest(nxt["y"], border + 1))
        cut = F.struct(last["x"].alias("x"), last["y"].alias("y"), last["w"].alias("w"), (new1 - last["y"] + 1).alias("h"))
        rest = F.struct(nxt["x"].cast("long").alias("x"), top2.cast("long").alias("y"), nxt["w"].cast("long").alias("w"), (bottom2 - top2 + 1).cast("long").alias("h"))
        own = F.struct(*[nxt[c].cast("long").alias(c) for c in "xywh"])
        overlap = (F.size(done) > 0) & (bottom1 >= nxt["y"])
        return F.when(overlap, F.concat(F.slice(done, 1, F.greatest(F.size(done) - 1, F.lit(0))), F.array(cut.cast(box)), F.array(rest))).otherwise(F.concat(done, F.array(own)))

    return rows.select("page", F.explode(F.aggregate("b", F.array().cast(f"array<{box}>"), add)).alias("r")).select("page", "r.*").where("w > 0 and h > 0")


def _merge_in_order(boxes: DataFrame, order: tuple[str, ...], joins: Callable[[Column, Column], Column], *, summed: tuple[str, ...] = ()) -> DataFrame:
    """Boxes of a page in order, each joined to the last box that was made if joins(last, box) says so; `summed` columns
    are added up. What is joined depends on what was joined before, so a page is a fold; the box still open is kept
    apart from the closed ones, so a step looks at no more than two boxes."""
    names = ("x", "y", "w", "h", *summed)
    box = f"struct<{','.join(f'{c}:bigint' for c in names)}>"
    entry = F.struct(*[F.col(c) for c in order], F.struct(*[F.col(c).cast("long").alias(c) for c in names]).alias("box"))
    # Columns of the order come first; boxes that are equal in it follow the rest of the box.
    rows = boxes.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda e: e["box"]).alias("b"))

    def union(a: Column, c: Column) -> Column:
        left, top = F.least(a["x"], c["x"]), F.least(a["y"], c["y"])
        right, bottom = F.greatest(a["x"] + a["w"], c["x"] + c["w"]), F.greatest(a["y"] + a["h"], c["y"] + c["h"])
        return F.struct(left.alias("x"), top.alias("y"), (right - left).alias("w"), (bottom - top).alias("h"), *[(a[n] + c[n]).alias(n) for n in summed])

    def add(state: Column, nxt: Column) -> Column:
        last = state["last"]
        closed = F.struct(F.when(last.isNull(), state["done"]).otherwise(F.array_append(state["done"], last)).alias("done"), nxt.alias("last"))
        # least and greatest pass over nulls, so the first box would seem to overlap a last one that is not there.
        return F.when(last.isNotNull() & F.coalesce(joins(last, nxt), F.lit(False)), F.struct(state["done"].alias("done"), union(last, nxt).alias("last"))).otherwise(closed)

    start = F.struct(F.array().cast(f"array<{box}>").alias("done"), F.lit(None).cast(box).alias("last"))
    return rows.select("page", F.inline(F.aggregate("b", start, add, lambda state: F.array_append(state["done"], state["last"]))))


def merge_line_boxes(boxes: DataFrame, height: int) -> DataFrame:
    """page, x, y, w, h: boxes from top to bottom, joined to the one before where they share over a quarter of the lower
    one's height, or where the gap between them is small against the page's height. A box that lies below a joined one is
    held against the whole of it. A page without boxes gives none."""
    # The least gap, its share of the height, the share of overlap.
    gap, share = max(4, int(height * 0.004)), 0.25

    def joins(last: Column, box: Column) -> Column:
        end1, end2 = last["y"] + last["h"] - 1, box["y"] + box["h"] - 1
        overlap = F.least(end1, end2) - F.greatest(last["y"], box["y"]) + 1
        return (overlap > F.least(last["h"], box["h"]) * F.lit(share)) | (box["y"] - end1 <= gap)

    return _merge_in_order(boxes, ("y", "x"), joins)


def merge_word_boxes(boxes: DataFrame, *order: str) -> DataFrame:
    """page, x, y, w, h, area: boxes in order (left to right unless said otherwise), joined to the one before where both
    overlap by over a share of the smaller one in width and in height; areas are added up."""
    share = 0.35  # fixed value

    def joins(last: Column, box: Column) -> Column:
        across = F.least(last["x"] + last["w"], box["x"] + box["w"]) - F.greatest(last["x"], box["x"])
        down = F.least(last["y"] + last["h"], box["y"] + box["h"]) - F.greatest(last["y"], box["y"])
        return (across > F.least(last["w"], box["w"]) * F.lit(share)) & (down > F.least(last["h"], box["h"]) * F.lit(share))

    return _merge_in_order(boxes, order or ("x", "y"), joins, summed=("area",))


def orientation(boxes: DataFrame, shape: DataFrame, tall: float = 0.18, touch: float = 0.35) -> DataFrame:
    """page, rotation, score, sideways. boxes: page, rotation, x, y, w, h; shape: page, rotation, width, height, also
    for rotations without boxes."""
    # The limits below and the defaults above.
    aspect = F.col("w") / F.greatest(F.lit(1), F.col("h"))
    good = (aspect >= 2.8) & (F.col("w") >= F.col("width") * 0.08)
    suspicious = (F.col("x") <= 2) & (F.col("h") >= F.col("height") * tall) & (F.col("w") >= F.col("width") * 0.22)
    points = F.when(good, 3.0 + F.least(aspect, F.lit(12.0)) * 0.30 + F.least(F.col("w") / F.greatest(F.lit(1), F.col("width")), F.lit(1.0)) * 2.0 + 1.5).otherwise(0.0)
    points = points - F.when(F.col("h") > F.col("w") * 0.70, 5.0).otherwise(0.0) - F.when(suspicious, 8.0).otherwise(0.0)
    keys = ["page", "rotation"]
    joined = shape.join(boxes, keys, "left")
    sums = joined.groupBy(*keys).agg(F.count("w").alias("n"), F.coalesce(F.sum(F.when(F.col("w").isNotNull(), points)), F.lit(0.0)).alias("p"), F.count_if(suspicious).alias("s"))
    return sums.select(*keys, F.round(F.col("p") - F.abs(F.col("n") - 14) * 0.15, 6).alias("score"), ((F.col("n") >= 3) & (F.col("s") / F.greatest(F.lit(1), F.col("n")) >= touch)).alias("sideways"))


def best_rotation(scores: DataFrame) -> DataFrame:
    """page, rotation: that of the best score, the first of 0, 90, 270 among equals."""
    return scores.groupBy("page").agg(F.max_by("rotation", F.struct("score", -F.col("rotation"))).alias("rotation"))


# Components and words --------------------------------------------------------------------------------------------
#: Side of the smallest cells in which components and boxes meet.
CELL = 64


def _in_cells(rows: DataFrame, p: str, other_levels: Column | None) -> DataFrame:
    """rows once a cell that they touch. Cells of level n have the side CELL * 2^n; a row's own level is the first whose
    cells are no smaller than it, where it touches four cells at most. other_levels: cells of those above the own one (as
    a guest); None: of the own one."""
    side = F.greatest(F.col(f"{p}w"), F.col(f"{p}h"), F.lit(1))
    own = F.greatest(F.ceil(F.log2(side / F.lit(float(CELL)))), F.lit(0)).cast("int")
    marked = rows.withColumn("_own", own)
    if other_levels is None:
        marked = marked.withColumn("_level", F.col("_own"))
    else:
        marked = marked.withColumn("_levels", other_levels).withColumn("_level", F.explode(F.filter("_levels", lambda n: n > F.col("_own")))).drop("_levels")
    size = F.call_function("shiftleft", F.lit(CELL).cast("long"), F.col("_level"))
    cells = lambda at, extent: F.explode(F.sequence(F.floor(F.col(at) / size), F.floor((F.col(at) + F.greatest(F.col(extent), F.lit(0))) / size)))
    return marked.withColumn("_cx", cells(f"{p}x", f"{p}w")).withColumn("_cy", cells(f"{p}y", f"{p}h")).drop("_own")


def compared_pairs(components: DataFrame, boxes: DataFrame) -> DataFrame:
    """Components with boxes (columns with the prefix b_) that share a cell of the page at the level of the larger of the
    two, once for each such cell: what components_in_boxes compares."""
    b = boxes.select("page", *[F.col(c).alias(f"b_{c}") for c in boxes.columns if c != "page"]).where("page is not null")
    c = components.where("page is not null")
    own_c, own_b = _in_cells(c, "", None), _in_cells(b, "b_", None)
    # At most one level for each power of two of a side.
    levels = lambda rows: rows.agg(F.coalesce(F.collect_set("_level"), F.array().cast("array<int>")).alias("l")).scalar()
    keys = ["page", "_level", "_cx", "_cy"]
    every_b = own_b.unionByName(_in_cells(b, "b_", levels(own_c)))
    return own_c.join(every_b, keys).unionByName(_in_cells(c, "", levels(own_b)).join(own_b, keys))


def components_in_boxes(components: DataFrame, boxes: DataFrame) -> DataFrame:
    """Each component with each box of its page that it overlaps (columns of the box have the prefix b_). They meet in the
    cells of the page that both touch; a pair counts in the cell that holds the upper left corner of what they share."""
    c = F.col
    meet = (c("x") + c("w") > c("b_x")) & (c("b_x") + c("b_w") > c("x")) & (c("y") + c("h") > c("b_y")) & (c("b_y") + c("b_h") > c("y"))
    size = F.call_function("shiftleft", F.lit(CELL).cast("long"), c("_level"))
    corner = (F.floor(F.greatest("x", "b_x") / size) == c("_cx")) & (F.floor(F.greatest("y", "b_y") / size) == c("_cy"))
    return compared_pairs(components, boxes).where(meet & corner).drop("_level", "_cx", "_cy")


def assign_to_lines(components: DataFrame, lines: DataFrame) -> DataFrame:
    """Components with line_index, the line whose centre is nearest (the first of equals). A component takes part in
    the join by page; a page's lines are few, so they travel as one array and no pairs are made."""
    centers = lines.groupBy("page").agg(F.array_sort(F.collect_list(F.struct("line_index", (F.col("y") + F.col("h") / 2.0).alias("c")))).alias("_l"))
    middle = F.col("y") + F.col("h") / 2.0
    nearest = F.array_min(F.transform("_l", lambda s: F.struct(F.abs(s["c"] - middle).alias("d"), s["line_index"].alias("line_index"))))
    return components.join(centers, "page").withColumn("line_index", nearest["line_index"]).drop("_l")


def component_medians(components: DataFrame, *keys: str) -> DataFrame:
    """keys, median_width, median_height."""
    width, height = (exact_percentiles(components, list(keys), c, **{name: 0.5}) for c, name in (("w", "median_width"), ("h", "median_height")))
    return width.join(height, list(keys))


def dilation_width(median_width: Column, line_width: Column, line_height: Column, by_height: float = 0.34, by_width: float = 0.03) -> Column:
    """How far the strokes of a word are spread; median_width null means no component."""
    # The limits below and the defaults above.
    width = F.bround(F.greatest(F.lit(7.0), F.least(F.lit(34.0), line_height * by_height, line_width * by_width, median_width * 1.35))).cast("int")
    return F.when(median_width.isNull(), F.greatest(F.lit(7), (line_height * by_height).cast("int"))).otherwise(F.greatest(F.lit(3), width))


def gap_threshold(median_width: Column, roi_width: Column) -> Column:
    """Least gap between words; median_width null means no component."""
    tenth, eighteenth = F.floor(roi_width / 10), F.floor(roi_width / 18)
    return F.when(median_width.isNull(), F.greatest(F.lit(40), eighteenth)).otherwise(F.greatest(F.lit(36.0), F.least(tenth.cast("double"), median_width * 2.4)).cast("int"))


def group_words(components: DataFrame, join_gap: Column) -> DataFrame:
    """Adds word_no: components of a line from left to right, a new word where the gap to the furthest right edge so
    far is over join_gap."""
    order = Window.partitionBy("page", "line_index").orderBy("x", "y", "w", "h")
    reach = F.max(F.col("x") + F.col("w")).over(order.rowsBetween(Window.unboundedPreceding, -1))
    new = F.coalesce((F.col("x") - reach > join_gap).cast("int"), F.lit(1))
    return components.withColumn("_new", new).withColumn("word_no", F.sum("_new").over(order)).drop("_new")


def word_boxes(words: DataFrame, width: int, height: int, *, pad_x: Column | int = 3, pad_y: Column | int = 3, min_width: int = 4, min_height: int = 4, min_ink: float = 4.0) -> DataFrame:
    """page, line_index, word_index, x, y, w, h, ink: padded bounds of each word's components within the page; boxes
    too small or with too little ink are dropped, the others numbered from left to right."""
    bounds = words.groupBy("page", "line_index", "word_no").agg(F.min("x").alias("x1"), F.min("y").alias("y1"), F.max(F.col("x") + F.col("w") - 1).alias("x2"), F.max(F.col("y") + F.col("h") - 1).alias("y2"), F.sum("area").alias("ink"))
    x, y = F.greatest(F.col("x1") - pad_x, F.lit(0)), F.greatest(F.col("y1") - pad_y, F.lit(0))
    boxes = bounds.select("page", "line_index", x.alias("x"), y.alias("y"), (F.least(F.col("x2") + pad_x, F.lit(width - 1)) - x + 1).alias("w"), (F.least(F.col("y2") + pad_y, F.lit(height - 1)) - y + 1).alias("h"), "ink")
    kept = boxes.where((F.col("w") >= min_width) & (F.col("h") >= min_height) & (F.col("ink") >= F.greatest(F.lit(min_ink), F.col("w") * 0.015)))
    return kept.withColumn("word_index", F.row_number().over(Window.partitionBy("page", "line_index").orderBy("x", "y")))


def word_padding(line_height: Column) -> tuple[Column, Column]:
    """Horizontal and vertical padding of the words of a line."""
    return F.greatest(F.lit(3), (line_height * 0.14).cast("int")), F.greatest(F.lit(3), (line_height * 0.08).cast("int"))


def drop_isolated_components(components: DataFrame, isolation_gap: Column, *, min_area: int = 4) -> DataFrame:
    """Without small components of a line that stand far from both neighbours (or, at an end, from their only one)."""
    large = components.where(F.col("area") >= min_area)
    order, line = Window.partitionBy("page", "line_index").orderBy("x", "w", "area", "y"), Window.partitionBy("page", "line_index")
    before = F.col("x") - (F.lag("x").over(order) + F.lag("w").over(order))
    after = F.lead("x").over(order) - (F.col("x") + F.col("w"))
    marked = large.withColumn("_b", before).withColumn("_a", after).withColumn("_m", F.percentile("area", F.lit(0.5)).over(line))
    far = (F.coalesce(F.col("_b") > isolation_gap, F.lit(True)) & F.coalesce(F.col("_a") > isolation_gap, F.lit(True))) & (F.col("_b").isNotNull() | F.col("_a").isNotNull())
    return marked.where(~(far & (F.col("area") < F.greatest(F.lit(50.0), F.col("_m") * 0.35)))).drop("_b", "_a", "_m")
