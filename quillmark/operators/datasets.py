"""Label vocabularies, labelled files, alignment of expected text with crops, splits and oversampling."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..functions.text import clean_words
from ..sources.shared import kept
from .evaluation import number_hashed, number_within

# Fixed values ---------------------------------------------------------------------------------------------------
REPEATS = {"clean": 1, "handwritten": 5, "demo": 20, "rpi": 25, "v53": 250}
MAX_PHRASE = 5
# -----------------------------------------------------------------------------------------------------------------


# Labels of files -------------------------------------------------------------------------------------------------
def true_label(file_name: Column, *, rule: str, folder: Column | None = None, folder_is_class: Column | None = None) -> Column:
    """The label a file's name (without extension) stands for. rule: 'last_part' drops what follows the last _;
    'digits' drops it if it is a number; 'folder' takes the folder if it is a class, else as 'digits'."""
    stem = F.regexp_replace(file_name, r"\.[^.]*$", "")
    if rule == "last_part":
        return F.regexp_replace(stem, r"_[^_]*$", "")
    digits = F.regexp_replace(stem, r"_\d+$", "")
    if rule == "digits":
        return digits
    if rule == "folder":
        return F.when(folder_is_class, folder).otherwise(digits)
    raise ValueError(f"unknown rule {rule!r}")


def known_items(items: DataFrame, labels: DataFrame) -> DataFrame:
    return items.join(labels.select("label"), "label", "left_semi")


def unknown_items(items: DataFrame, labels: DataFrame) -> DataFrame:
    return items.join(labels.select("label"), "label", "left_anti")


def with_class_index(items: DataFrame, labels: DataFrame) -> DataFrame:
    return items.join(labels.select("label", "label_index"), "label")


def unknown_label_counts(words: DataFrame, labels: DataFrame) -> DataFrame:
    """label, n over all lines, those that are skipped later included. Words are counted first, so that a word meets the
    labels once, however frequent it is."""
    return unknown_items(words.groupBy("label").agg(F.count("*").alias("n")), labels)


def distinct_labels(items: DataFrame) -> DataFrame:
    return items.select("label").distinct()


# Sets of labels --------------------------------------------------------------------------------------------------
def all_labels(*sources: DataFrame) -> DataFrame:
    out = sources[0].select("label")
    for other in sources[1:]:
        out = out.union(other.select("label"))
    return out.distinct()


def only_in(source: DataFrame, *others: DataFrame) -> DataFrame:
    out = source.select("label").distinct()
    for other in others:
        out = out.subtract(other.select("label"))
    return out


def vocabulary_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """label, change: 'added' or 'removed'."""
    return only_in(new, old).withColumn("change", F.lit("added")).union(only_in(old, new).withColumn("change", F.lit("removed")))


def order_vocabulary(base: DataFrame, found: DataFrame, *, allow_new: bool = True) -> DataFrame:
    """label, label_index: the base's order, then new labels sorted. allow_new=False makes any new label an error when
    the result is evaluated. New labels are numbered by their rank among a vocabulary, which is small next to data."""
    new = only_in(found, base)
    if not allow_new:
        new = new.where(F.raise_error(F.concat(F.lit("label not in the vocabulary: "), F.col("label"))).isNull())
    ranked = new.withColumn("late", F.lit(1)).withColumn("at", F.lit(0).cast("long"))
    both = base.select("label", F.lit(0).alias("late"), F.col("label_index").cast("long").alias("at")).unionByName(ranked)
    return both.select("label", (F.row_number().over(Window.orderBy("late", "at", "label")) - 1).alias("label_index"))


# Alignment -------------------------------------------------------------------------------------------------------
#: Bound on the bytes of a vocabulary's phrases that are broadcast.
PHRASE_BYTES = 16 << 20


def phrase_labels(lines: DataFrame, labels: DataFrame, keys: list[str], column: str = "text", longest: int = MAX_PHRASE, most_bytes: int = PHRASE_BYTES) -> DataFrame:
    """keys, label_no, label: a line's words as labels, at each place the longest phrase (words joined by _) of the
    vocabulary, else the word. A word alone is its own label whether the vocabulary has it or not, so only the labels of
    several words matter. They meet the runs of two to `longest` words of the lines in a join; up to most_bytes of them are
    broadcast, so that only what is found is shuffled."""
    return phrase_lists(lines, labels, keys, column, longest, most_bytes).select(*keys, F.posexplode("labels").alias("label_no", "label")).withColumn("label_no", F.col("label_no") + 1)


def phrase_lists(lines: DataFrame, labels: DataFrame, keys: list[str], column: str = "text", longest: int = MAX_PHRASE, most_bytes: int = PHRASE_BYTES) -> DataFrame:
    """keys, labels: the labels of phrase_labels as one array a line."""
    words = lines.select(*keys, clean_words(F.col(column)).alias("words"))
    phrases = labels.where(F.contains("label", F.lit("_"))).select("label").distinct()
    parts = F.size(F.split("label", "_"))
    size, most = phrases.agg(F.coalesce(F.sum(F.octet_length("label") + 16), F.lit(0)), F.coalesce(F.max(parts), F.lit(1))).first()
    longest = min(longest, most)
    if longest < 2:
        return words.withColumnRenamed("words", "labels")
    spans = _joined_spans(words, F.broadcast(phrases) if size <= most_bytes else phrases, keys, longest)
    # Each word with a sign for the words that its label takes; a match from the left takes them, as a label does.
    signs = [chr(0x2460 + n) for n in range(longest + 1)]
    signed = F.zip_with("spans", "words", lambda n, w: F.concat(F.get(F.array(*map(F.lit, signs)), n), w))
    run = "|".join(signs[n] + r"\S+" + rf"(?: \S+){{{n - 1}}}" for n in range(1, longest + 1))
    taken = F.regexp_extract_all(F.array_join(signed, " "), F.lit(run), F.lit(0))
    chosen = F.transform(taken, lambda t: F.when(F.startswith(t, F.lit(signs[1])), F.substring(t, 2, 1 << 30)).otherwise(F.regexp_replace(F.substring(t, 2, 1 << 30), " .", "_")))
    return spans.select(*keys, F.when(F.exists("spans", lambda n: n > 1), chosen).otherwise(F.col("words")).alias("labels"))


def _phrase_at(i: Column, n: Column | int) -> Column:
    return F.array_join(F.slice("words", i + 1, n), "_")


def _joined_spans(words: DataFrame, phrases: DataFrame, keys: list[str], longest: int) -> DataFrame:
    """words with spans: how many words the label at each place takes."""
    last = F.size("words")
    at = lambda i: F.transform(F.sequence(F.lit(2), F.least(F.lit(longest), last - i)), lambda k: F.struct(i.alias("i"), k.alias("n"), _phrase_at(i, k).alias("label")))
    every = F.flatten(F.transform(F.sequence(F.lit(0), last - 2), at))
    grams = words.where(last > 1).select(*keys, F.explode(every).alias("g")).select(*keys, "g.*")
    hits = grams.join(phrases, "label", "left_semi")
    every = hits.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("i", (-F.col("n")).alias("n")))).alias("every"))
    # The longest run of each place comes first.
    longest_at = text.let(F.col("every"), lambda a: F.filter(a, lambda h, k: (k == 0) | (F.get(a, k - 1)["i"] != h["i"])))
    spots = every.select(*keys, F.transform(longest_at, lambda h: F.struct(h["i"].alias("i"), (-h["n"]).alias("n"))).alias("at"))
    # Runs of ones between the places that are found, so that no place is looked for.
    def filled(found: Column) -> Column:
        gap = lambda h, k: F.concat(F.array_repeat(F.lit(1), h["i"] - F.when(k > 0, F.get(found, k - 1)["i"] + 1).otherwise(0)), F.array(h["n"]))
        until = F.coalesce(F.get(found, F.size(found) - 1)["i"] + 1, F.lit(0))
        return F.concat(F.flatten(F.transform(found, gap)), F.array_repeat(F.lit(1), F.size("words") - until))

    none = F.array().cast("array<struct<i:int,n:int>>")
    return words.join(spots, keys, "left").withColumn("spans", text.let(F.coalesce("at", none), filled)).drop("at")


#: Bound on the bytes of unknown words that are broadcast.
UNKNOWN_BYTES = 16 << 20


def _marked(expected: DataFrame, labels: DataFrame, most_bytes: int = UNKNOWN_BYTES) -> DataFrame:
    """expected with unknown: whether the vocabulary lacks the label. The words that it lacks are found once from the
    distinct words and written, so that the lines' words are not joined with the whole vocabulary, nor shuffled for it where
    those words are few."""
    unknown = kept(unknown_label_counts(expected, labels).where("label IS NOT NULL").select("label"), "unknown")
    size = unknown.agg(F.coalesce(F.sum(F.octet_length("label") + 16), F.lit(0))).first()[0]
    flags = unknown.withColumn("_found", F.lit(True))
    found = expected.join(F.broadcast(flags) if size <= most_bytes else flags, "label", "left")
    return found.withColumn("unknown", F.col("label").isNull() | F.col("_found").isNotNull()).drop("_found")


def _status() -> Column:
    return F.when(F.col("n_expected") != F.col("n_crops"), "crop_count_mismatch").when(F.col("unknown"), "unknown_label").otherwise("ok")


def check_lines(expected: DataFrame, crops: DataFrame, labels: DataFrame, keys: list[str]) -> DataFrame:
    """keys, n_expected, n_crops, status of each line with either: 'crop_count_mismatch', 'unknown_label' or 'ok'."""
    one, none = F.lit(1), F.lit(0)
    both = _marked(expected, labels).select(*keys, one.alias("e"), none.alias("c"), "unknown").unionByName(crops.select(*keys, none.alias("e"), one.alias("c"), F.lit(False).alias("unknown")))
    lines = both.groupBy(*keys).agg(F.sum("e").alias("n_expected"), F.sum("c").alias("n_crops"), F.max("unknown").alias("unknown"))
    return lines.withColumn("status", _status()).drop("unknown")


def align(expected: DataFrame, crops: DataFrame, labels: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """(labelled crops of the lines that are ok, the other lines). A line's labels and crops are gathered in one shuffle and
    the k-th crop gets the k-th label, whatever numbers the crops carry; no join is made by line or place."""
    word, crop = F.struct("label_no", "label"), F.struct("word_index", *[c for c in crops.columns if c not in (*keys, "word_index")])
    nothing = lambda rows, c: F.lit(None).cast(rows.select(c.alias("x")).schema["x"].dataType)
    words = _marked(expected, labels)
    both = words.select(*keys, word.alias("word"), nothing(crops, crop).alias("crop"), "unknown").unionByName(crops.select(*keys, nothing(words, word).alias("word"), crop.alias("crop"), F.lit(False).alias("unknown")))
    lines = both.groupBy(*keys).agg(F.array_sort(F.collect_list("word")).alias("words"), F.array_sort(F.collect_list("crop")).alias("crops"), F.max("unknown").alias("unknown"))
    return align_lists(lines.withColumn("words", F.col("words.label")), keys)


def align_lists(lines: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """align for lines whose labels and crops lie in one row: keys, words and crops (labels and structs, each in order) and
    unknown (of mark_unknown). Nothing is shuffled. A line with neither labels nor crops is none."""
    counted = lines.withColumn("n_expected", F.size("words").cast("long")).withColumn("n_crops", F.size("crops").cast("long")).withColumn("status", _status())
    # Without _outer, Spark would look for empty lists first, which makes it take the words out of each line twice.
    placed = counted.where("status = 'ok'").select(*keys, "crops", F.posexplode_outer("words").alias("_place", "label")).where("_place IS NOT NULL")
    labelled = placed.select(*keys, "label", F.get("crops", F.col("_place")).alias("_crop")).select(*keys, "label", "_crop.*")
    return labelled, counted.where("status <> 'ok'").select(*keys, "n_expected", "n_crops", "status")


#: Bound on the longs of a sieve (16 MB).
SIEVE_SLOTS = 1 << 21


def _sieve(members: DataFrame, most_slots: int = SIEVE_SLOTS) -> Column:
    """Whether `label` may be a member's: true for every member, and for few other labels as long as there are ten bits or
    more to a member. A label's hash names a long of the sieve and three of its bits. Tasks get the sieve as one array,
    whose size is bounded, however many members there are."""
    slots = 1 << min((members.count() * 24 // 64).bit_length(), most_slots.bit_length() - 1)
    label_hash = F.xxhash64("label")
    slot = F.shiftrightunsigned(label_hash, 24).bitwiseAND(F.lit(slots - 1).cast("long"))
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), F.shiftrightunsigned(label_hash, 6 * n).bitwiseAND(F.lit(63).cast("long")).cast("int"))
    bits = bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))
    empty = members.sparkSession.range(slots).select(F.col("id").alias("slot"), F.lit(0).cast("long").alias("bits"))
    longs = members.select(slot.alias("slot"), bits.alias("bits")).union(empty).groupBy("slot").agg(F.bit_or("bits").alias("bits"))
    # In two steps, so that no task holds a struct for each long.
    in_order = lambda at: F.col(f"rows.{at}")
    blocks = longs.groupBy(F.shiftright("slot", 10).alias("block")).agg(F.array_sort(F.collect_list(F.struct("slot", "bits"))).alias("rows")).select("block", in_order("bits").alias("bits"))
    whole = blocks.agg(F.array_sort(F.collect_list(F.struct("block", "bits"))).alias("rows")).select(F.flatten(in_order("bits")))
    return F.get(whole.scalar(), slot.cast("int")).bitwiseAND(bits) == bits


def unknown_lines(expected: DataFrame, unknown: DataFrame, keys: list[str], most_slots: int = SIEVE_SLOTS) -> DataFrame:
    """keys of the lines with a label that is among the unknown ones (distinct), or null. Only labels that a sieve lets pass
    are shuffled to meet the unknown ones, so neither all words of the lines are, nor are the unknown ones broadcast, whose
    number grows with the lines."""
    held = expected.select(*keys, "label").where(F.col("label").isNull() | _sieve(unknown, most_slots))
    found = held.join(unknown.select("label", F.lit(True).alias("_found")), "label", "left")
    return found.where(F.col("label").isNull() | F.col("_found")).select(*keys).distinct()


def mark_unknown(lines: DataFrame, found: DataFrame, key: str, number: str) -> DataFrame:
    """lines with unknown: whether the line is among those found (key, number). A key's numbers (from 1) come as one array to
    lines that are dealt out by the key, which are neither shuffled again nor sorted."""
    flags = lambda a: F.flatten(F.transform(a, lambda n, i: F.concat(F.array_repeat(F.lit(False), (n - F.when(i > 0, F.get(a, i - 1)).otherwise(0) - 1).cast("int")), F.array(F.lit(True)))))
    # The key comes as an aggregate, as a test for null on the key itself would reach the scan of the found lines only, and what
    # the lines and the found ones both read would be shuffled twice.
    lists = found.groupBy(F.col(key).alias("_key")).agg(F.max(key).alias(key), F.array_sort(F.collect_set(number)).alias("_n"))
    by_key = lists.select(key, text.let(F.col("_n"), flags).alias("_flags"))
    marked = lines.join(by_key.hint("shuffle_hash"), key, "left")
    return marked.withColumn("unknown", F.coalesce(F.get("_flags", F.col(number) - 1), F.lit(False))).drop("_flags")


def alignment_summary(labelled: DataFrame, skipped: DataFrame) -> DataFrame:
    """One row: copied, unique_labels, skipped_lines."""
    n = skipped.agg(F.count("*").alias("skipped_lines"))
    return labelled.agg(F.count("*").alias("copied"), F.countDistinct("label").alias("unique_labels")).withColumn("skipped_lines", n.scalar())


# Splits and samples ----------------------------------------------------------------------------------------------
def split_sizes(n: Column) -> tuple[Column, Column]:
    """Sizes of train and validation for a class of n items (3 at least); the rest is test."""
    return F.when(n == 3, 1).otherwise(F.greatest(F.lit(1), (n * F.lit(0.7)).cast("int"))), F.greatest(F.lit(1), (n * F.lit(0.15)).cast("int"))


def stratified_split(items: DataFrame, order_key: Column | None = None, seed: int = 42) -> DataFrame:
    """Adds split: train, val or test within each label, in the order of a hash of the path. A label with fewer than
    three items is an error when the result is evaluated."""
    order_key = F.xxhash64("path", F.lit(seed)) if order_key is None else order_key
    n, r = F.col("_n"), F.row_number().over(Window.partitionBy("label").orderBy(order_key, "path"))
    train, val = split_sizes(n)
    few = F.raise_error(F.concat(F.lit("fewer than 3 items: "), F.col("label")))
    name = F.when(n < 3, few).when(F.col("_r") <= train, "train").when(F.col("_r") <= train + val, "val").otherwise("test")
    return items.withColumn("_n", F.count("*").over(Window.partitionBy("label"))).withColumn("_r", r).withColumn("split", name).drop("_n", "_r")


def tail_holdout(items: DataFrame, share: float = 0.15) -> DataFrame:
    """The last max(1, int(share * n)) items of each label by path; labels of one item have none."""
    w = Window.partitionBy("label")
    late = F.row_number().over(w.orderBy(F.desc("path")))
    return items.withColumn("_n", F.count("*").over(w)).withColumn("_r", late).where((F.col("_n") >= 2) & (F.col("_r") <= F.greatest(F.lit(1), (F.col("_n") * F.lit(share)).cast("int")))).drop("_n", "_r")


def oversample(items: DataFrame, repeats: dict[str, int] | None = None) -> DataFrame:
    """Each item as often as its source says, with copy_no; sources of repeat 0 or unknown ones add nothing. Items are dealt
    out before they are repeated: a small file is read by one task, which would then make all copies of its items."""
    pairs = [F.lit(v) for kv in (REPEATS if repeats is None else repeats).items() for v in kv]
    times = F.coalesce(F.try_element_at(F.create_map(*pairs), F.col("source")), F.lit(0))
    dealt = items.withColumn("_t", times).where("_t >= 1").repartition(int(items.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return dealt.withColumn("copy_no", F.explode(F.sequence(F.lit(1), F.col("_t")))).drop("_t")


def merge_sources(*sources: DataFrame) -> DataFrame:
    out = sources[0]
    for other in sources[1:]:
        out = out.unionByName(other)
    return out


def shuffled(items: DataFrame, seed: int = 42, order_key: Column | None = None) -> DataFrame:
    """Adds place: the row's number (from 1) in a reproducible random order, that of a hash: order_key, best a long or binary."""
    key = F.xxhash64("path", "copy_no", F.lit(seed)) if order_key is None else order_key
    return number_hashed(items.withColumn("_key", key), ["_key", "path", "copy_no"], "place").drop("_key")


def source_counts(items: DataFrame) -> DataFrame:
    return items.groupBy("source", "label").agg(F.count("*").alias("n"))


def split_summary(items: DataFrame) -> DataFrame:
    """label, total, train, val, test."""
    counts = [F.count_if(F.col("split") == s).alias(s) for s in ("train", "val", "test")]
    return items.groupBy("label").agg(F.count("*").alias("total"), *counts)


def sequence_numbers(items: DataFrame, existing: DataFrame) -> DataFrame:
    """Adds sequence_no: items of a label, in the order of their paths, numbered on from the greatest that exists (label,
    sequence_no). However many items a label has, they are not gathered in one task."""
    have = existing.groupBy("label").agg(F.max("sequence_no").alias("_have"))
    numbered = number_within(items, ["label"], ["path"], "sequence_no")
    return numbered.join(F.broadcast(have) if _is_small(have) else have, "label", "left").withColumn("sequence_no", F.coalesce("_have", F.lit(0)) + F.col("sequence_no")).drop("_have")


#: Bound on the labels whose greatest numbers are broadcast.
MOST_LABELS = 200_000


def _is_small(labels: DataFrame) -> bool:
    return labels.limit(MOST_LABELS + 1).count() <= MOST_LABELS
