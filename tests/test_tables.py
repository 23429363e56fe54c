"""Records, layout, datasets and evaluation on small tables and by properties."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark import plans
from quillmark.operators import datasets, evaluation, layout, recognition, records
from quillmark.plans import bindings


def test_restore_undoes_deletion(spark, sf):
    batches, pages = records.roll_up(bindings.batches(spark, sf).where("NOT is_deleted"), bindings.pages(spark, sf)), bindings.pages(spark, sf).where("NOT is_deleted")
    ids = batches.where("id % 3 = 0").select("batch_id")
    gone, gone_pages = records.delete_batches(batches, pages, ids)
    assert gone.where("is_deleted AND upload_status = 'deleted'").count() == ids.count()
    back, back_pages = records.restore_batches(gone, gone_pages, ids)
    assert back.select(*batches.columns).exceptAll(batches).count() == 0 and back_pages.exceptAll(pages).count() == 0


def test_renumbering_is_dense(spark, sf):
    pages = bindings.pages(spark, sf)
    after = records.delete_pages(pages, pages.where("page_id % 4 = 0").select("page_id"))
    touched = pages.where("page_id % 4 = 0").select("batch_id").distinct()
    sizes = after.join(touched, "batch_id", "left_semi").groupBy("batch_id").agg(F.count("*").alias("n"), F.max("page_number").alias("m"), F.countDistinct("page_number").alias("d"))
    assert sizes.where("n <> m OR n <> d").count() == 0


def test_roll_up_counts_null_confidence_as_zero(spark):
    batches = spark.createDataFrame([("a",), ("b",)], "batch_id string")
    pages = spark.createDataFrame([("a", i, i, 1, "", f"p{i} ", c, False) for i, c in ((1, 80.0), (2, None), (3, 100.0))], "batch_id string, page_id long, page_number int, x int, edited_text string, raw_text string, confidence double, is_deleted boolean")
    rows = {r["batch_id"]: r for r in records.roll_up(batches, pages).collect()}
    assert (rows["a"]["confidence_avg"], rows["a"]["transcript_text"], rows["a"]["upload_status"]) == (60.0, "p1\n\np2\n\np3", "processed")
    assert (rows["b"]["confidence_avg"], rows["b"]["total_pages"], rows["b"]["upload_status"]) == (0.0, 0, "pending")


def test_refused_metadata(spark):
    batches = spark.createDataFrame([(b, b, F_TIME, False) for b in "abc"], "batch_id string, title string, created_at string, is_deleted boolean")
    metadata = spark.createDataFrame([("a", "CC-1234", "1")], "batch_id string, criminal_case_no string, updated_at string")
    changes = spark.createDataFrame([("b", " cc/1234 ", "2"), ("c", "CC-9999", "2"), ("z", "CC-1", "2")], "batch_id string, criminal_case_no string, updated_at string")
    after = {r["batch_id"]: r["criminal_case_no"] for r in records.upsert_metadata(metadata, changes, batches, refuse_similar=True).collect()}
    assert after == {"a": "CC-1234", "c": "CC-9999"}


F_TIME = "2024-01-01"


def test_added_columns(spark):
    assert records.evolve(spark.range(1), {"id": F.lit(5), "new": F.lit("d")}).first().asDict() == {"id": 0, "new": "d"}


def separated(boxes):
    boxes = [list(b) for b in boxes]
    for first, second in zip(boxes, boxes[1:], strict=False):
        end1, end2 = first[1] + first[3] - 1, second[1] + second[3] - 1
        if end1 >= second[1]:
            border = int(round((first[1] + first[3] / 2 + second[1] + second[3] / 2) / 2))
            top2 = min(end2, max(second[1], border + 1))
            first[3], second[1], second[3] = max(first[1], min(end1, border)) - first[1] + 1, top2, end2 - top2 + 1
    return sorted(tuple(b) for b in boxes if b[2] > 0 and b[3] > 0)


def test_overlapping_lines_are_separated(spark):
    rng = random.Random(1)
    pages = {p: sorted([(rng.randrange(50), rng.randrange(60), rng.randrange(1, 30), rng.randrange(1, 25)) for _ in range(rng.randrange(1, 9))], key=lambda b: (b[1], b[0], b[2], b[3])) for p in range(60)}
    frame = spark.createDataFrame([(p, *b) for p, boxes in pages.items() for b in boxes], "page int, x int, y int, w int, h int")
    got = {}
    for r in layout.separate_overlaps(frame).collect():
        got.setdefault(r["page"], []).append((r["x"], r["y"], r["w"], r["h"]))
    assert {p: sorted(b) for p, b in got.items()} == {p: separated(b) for p, b in pages.items()}


def test_split_sizes_equal_the_stepwise_rule(spark):
    rows = spark.range(3, 1001).select("id", *[c.alias(n) for n, c in zip(("train", "val"), datasets.split_sizes(F.col("id")), strict=True)]).collect()
    for r in rows:
        n = r["id"]
        train, val = max(1, int(n * 0.7)), max(1, int(n * 0.15))
        while train + val + max(1, n - train - val) > n:
            train -= 1
        assert (r["train"], r["val"]) == (train, val)


def test_split_guard_and_vocabulary_guard(spark):
    few = spark.createDataFrame([("p1", "a"), ("p2", "a")], "path string, label string")
    with pytest.raises(PySparkException, match="fewer than 3"):
        datasets.stratified_split(few).collect()
    base = spark.createDataFrame([("a", 0)], "label string, label_index int")
    with pytest.raises(PySparkException, match="not in the vocabulary"):
        datasets.order_vocabulary(base, spark.createDataFrame([("b",)], "label string"), allow_new=False).collect()


def test_phrases(spark):
    lines = spark.createDataFrame([(1, "Your honor, yes"), (2, "")], "line int, text string")
    labels = spark.createDataFrame([("your",), ("your_honor",), ("yes",)], "label string")
    assert [(r["line"], r["label"]) for r in datasets.phrase_labels(lines, labels, ["line"]).orderBy("line", "label_no").collect()] == [(1, "your_honor"), (1, "yes")]


def test_shuffle_is_reproducible(spark, sf):
    items = bindings.items(spark, sf).withColumn("copy_no", F.lit(1))
    order = [r["path"] for r in datasets.shuffled(items).collect()]
    assert order == [r["path"] for r in datasets.shuffled(items.repartition(3)).collect()] and order != sorted(order)


def test_rank_scores_and_ties(spark):
    row = spark.createDataFrame([([0.2, 0.5, 0.5, 0.1],)], "s array<double>").select(recognition.rank_scores(F.col("s"), F.lit(["a", "b", "c"]), 4).alias("t")).first()
    assert [(c["label"], c["confidence"]) for c in row["t"]] == [("b", 50.0), ("c", 50.0), ("a", 20.0), ("class_3", 10.0)]


def test_rerank_follows_chosen_words(spark):
    top = lambda *c: [{"label": a, "confidence": b} for a, b in c]
    words = [(1, 1, 1, top(("thx", 60.0), ("the", 55.0))), (1, 1, 2, top(("cart", 50.0), ("court", 45.0))), (1, 1, 3, top(("cart", 90.0), ("court", 89.0))), (1, 1, 4, top(("zz", 50.0), ("court", 30.0)))]
    frame = spark.createDataFrame(words, "page int, line_index int, word_index int, top5 array<struct<label:string,confidence:double>>")
    rows = recognition.rerank(frame).orderBy("word_index").collect()
    assert [(r["chosen"], r["by_context"]) for r in rows] == [("thx", False), ("court", True), ("cart", False), ("zz", False)]


def test_scorer_isolates_failing_rows(spark):
    def load():
        def scorer(batch):
            if (batch["x"] < 0).any():
                raise ValueError("below zero")
            return [[float(v), 1.0] for v in batch["x"]]

        return scorer

    rows = recognition.score(spark.createDataFrame([(1, 1.0), (2, -1.0), (3, 3.0)], "id long, x double").coalesce(1), load, key="id", features=["x"]).orderBy("id").collect()
    assert [r["scores"] for r in rows] == [[1.0, 1.0], None, [3.0, 1.0]] and rows[1]["error"] == "ValueError: below zero"


def test_missing_pairs_fail(spark):
    report = spark.createDataFrame([("a", "b")], "true_label string, predicted_label string")
    assert evaluation.require_pairs(report, report).count() == 1
    with pytest.raises(PySparkException, match="not in the report"):
        evaluation.require_pairs(spark.createDataFrame([("a", "z")], "true_label string, predicted_label string"), report).collect()


def test_accuracy_of_nothing(spark):
    rows = spark.createDataFrame([], "top1_result string, top5_result string, error string, known boolean")
    assert evaluation.accuracies(rows, denominator="all").first()["top1_accuracy"] == 0.0


def test_empty_page_scores(spark):
    words = spark.createDataFrame([], "page int, line_index int, confidence double")
    assert recognition.page_scores(words, spark.createDataFrame([(4,)], "page int")).first().asDict() == {"page": 4, "confidence": 0.0, "rows_detected": 0, "words_detected": 0, "low_confidence_words": 0}


def test_numbers_spread_names_that_begin_alike(spark):
    from quillmark.operators import evaluation

    names = spark.range(3000).selectExpr("concat('img_', lpad(id, 9, '0')) AS name", "id")
    rows = evaluation.number_rows(names, ["name"])
    assert rows.where("row_no <> id + 1").count() == 0
    assert evaluation.number_rows(names.limit(0), ["name"]).count() == 0
    doubled = spark.createDataFrame([("a", 1), ("a", 2), (None, 3), ("b", 4)], "name string, k int")
    assert sorted(r["row_no"] for r in evaluation.number_rows(doubled, ["name", "k"]).collect()) == [1, 2, 3, 4]


def test_numbers_in_a_thousand_ranges_with_a_common_key(spark):
    """A key with a third of the rows is cut into ranges like any other; equal rows are numbered each."""
    rows = spark.range(30_000).selectExpr("IF(id % 3 = 0, 'same', concat('img_', lpad(id, 9, '0'))) AS name", "id % 7 AS v", "id % 5 = 0 AS flag")
    placed = evaluation.in_ranges(rows, ["name"], rows_a_range=30)
    sizes = [r["n"] for r in placed.groupBy(F.shiftright("_place", 33).alias("range")).agg(F.count("*").alias("n")).collect()]
    assert len(sizes) > 900 and sum(sizes) == 30_000 and max(sizes) < 150
    got = evaluation.number_rows(rows, ["name"], rows_a_range=30).orderBy("row_no").collect()
    assert [r["row_no"] for r in got] == list(range(1, 30_001)) and [r["name"] for r in got] == sorted(r["name"] for r in got)
    within = evaluation.number_within(rows, ["flag", "name"], ["v"], "no", rows_a_range=500).collect()
    groups = {}
    for r in within:
        groups.setdefault((r["flag"], r["name"]), []).append((r["no"], r["v"]))
    assert sum(map(len, groups.values())) == 30_000 and max(map(len, groups.values())) == 8000
    for found in groups.values():
        found.sort()
        assert [n for n, _ in found] == list(range(1, len(found) + 1)) and [v for _, v in found] == sorted(v for _, v in found)


def test_labels_are_numbered_on(spark):
    items = spark.createDataFrame([(l, f"p{i:03}") for i, l in enumerate("aabbbc")] + [(None, "p9"), (None, "p8")], "label string, path string")
    old = spark.createDataFrame([("a", 4), ("a", 7), ("z", 3)], "label string, sequence_no long")
    got = sorted((str(r["label"]), r["path"], r["sequence_no"]) for r in datasets.sequence_numbers(items, old).collect())
    assert got == [("None", "p8", 1), ("None", "p9", 2), ("a", "p000", 8), ("a", "p001", 9), ("b", "p002", 1), ("b", "p003", 2), ("b", "p004", 3), ("c", "p005", 1)]


def test_components_meet_boxes_in_cells(spark):
    rng = random.Random(5)
    box = lambda big: (rng.randrange(0, 12_000), rng.randrange(0, 12_000), rng.randrange(0, big), rng.randrange(0, big))
    some = lambda n, big: [(p, k, *box(big)) for p in (1, 2) for k in range(n)]
    schema = "page int, k int, x int, y int, w int, h int"
    small, large = some(150, 300) + [(1, 900, 64, 64, 64, 64), (1, 901, 0, 0, 0, 5)], some(150, 6000) + [(None, 1, 0, 0, 9, 9), (1, 902, 128, 64, 1, 1), (1, 903, 127, 127, 1, 1)]
    meets = lambda c, b: c[0] == b[0] and c[2] + c[4] > b[2] and b[2] + b[4] > c[2] and c[3] + c[5] > b[3] and b[3] + b[5] > c[3]
    for a, b in ((small, large), (large, small), (small, small)):
        got = layout.components_in_boxes(spark.createDataFrame(a, schema), spark.createDataFrame(b, schema)).select("page", "k", "b_k").collect()
        assert sorted(map(tuple, got)) == sorted((c[0], c[1], d[1]) for c in a for d in b if meets(c, d))
    page = spark.range(10_000).selectExpr("1 AS page", "id AS k", "(id % 100) * 40 AS x", "floor(id / 100) * 40 AS y", "30 AS w", "30 AS h")
    assert layout.compared_pairs(page, page).count() < 0.01 * 10_000 * 10_000
    assert layout.components_in_boxes(page, page).count() == 10_000
    assert layout.components_in_boxes(page.limit(0), page).count() == 0


def test_phrases_by_buckets_and_by_join(spark):
    rng = random.Random(9)
    words = ["a", "b", "c", "d", "a_b", "it's"]
    vocabulary = {"_".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(60)}
    lines = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) for _ in range(80)] + ["", None]

    def plain(line):
        out, at, w = [], 0, (line or "").split()
        while at < len(w):
            n = next((n for n in range(min(5, len(w) - at), 0, -1) if "_".join(w[at : at + n]) in vocabulary), 1)
            out.append("_".join(w[at : at + n]))
            at += n
        return out

    rows = spark.createDataFrame(list(enumerate(lines)), "line int, text string")
    labels = spark.createDataFrame([(v,) for v in vocabulary], "label string")
    want = [(i, n, label) for i, line in enumerate(lines) for n, label in enumerate(plain(line), 1)]
    for most in (0, datasets.PHRASE_BYTES):
        got = datasets.phrase_labels(rows, labels, ["line"], most_bytes=most)
        assert sorted(map(tuple, got.collect())) == want
    assert sorted(map(tuple, datasets.phrase_labels(rows, labels.limit(0), ["line"]).collect())) == [(i, n, w) for i, line in enumerate(lines) for n, w in enumerate((line or "").split(), 1)]


def test_peaks_and_shoulders(spark):
    from quillmark.operators import layout

    def plain(v, threshold):
        found, y = [], 1
        while y < len(v) - 1:
            if v[y] < threshold or v[y] < v[y - 1] or v[y] < v[y + 1]:
                y += 1
                continue
            end = y
            while end + 1 < len(v) and v[end + 1] == v[y]:
                end += 1
            found.append((y + end) // 2)
            y = end + 1
        return found

    import random

    rng = random.Random(8)
    profiles = [[1, 3, 3, 5, 1], [1, 5, 3, 3, 1], [2, 2], [3], [3, 3, 3], [1, 2, 2]] + [[rng.randint(0, 4) for _ in range(rng.randint(1, 12))] for _ in range(200)]
    rows = spark.createDataFrame([(i, y, v) for i, p in enumerate(profiles) for y, v in enumerate(p)], "page int, y int, v int")
    got = {}
    for r in layout.peaks(rows, 2).collect():
        got.setdefault(r["page"], []).append(r["y"])
    assert {i: sorted(p) for i, p in got.items()} == {i: w for i, p in enumerate(profiles) if (w := plain(p, 2))}
    assert got[0] == [1, 3] or sorted(got[0]) == [1, 3]
    high = spark.createDataFrame([(1, 2, 5), (1, 4, 7), (1, 6, 7), (1, 20, 1)], "page int, y int, v int")
    assert sorted(r["y"] for r in layout.suppress_peaks(high, 3).collect()) == [4, 20]


def test_running_merges_hold_against_the_whole_merged_box(spark):
    schema = "page int, x int, y int, w int, h int, area int"
    boxes = spark.createDataFrame([(1, 0, 0, 10, 10, 1), (1, 5, 8, 30, 20, 2), (1, 0, 31, 5, 5, 4), (1, 0, 41, 5, 5, 8), (2, 3, 3, 3, 3, 16), (3, 0, 0, 4, 4, 32), (3, 0, 0, 4, 4, 32)], schema)
    # The third lies 4 below the joined first two, the fourth 6 below that.
    assert sorted(tuple(r) for r in layout.merge_line_boxes(boxes, 500).collect()) == [(1, 0, 0, 35, 36), (1, 0, 41, 5, 5), (2, 3, 3, 3, 3), (3, 0, 0, 4, 4)]
    words = spark.createDataFrame([(1, 0, 0, 10, 10, 1), (1, 6, 0, 10, 10, 2), (1, 11, 0, 10, 10, 4), (1, 20, 0, 10, 10, 8), (2, 0, 0, 10, 10, None)], schema)
    # The second overlaps the first by 4 of 10, the third the joined box by 5; the fourth by 1.
    assert sorted(tuple(r)[:5] for r in layout.merge_word_boxes(words).collect()) == [(1, 0, 0, 21, 10), (1, 20, 0, 10, 10), (2, 0, 0, 10, 10)]
    assert {r["area"] for r in layout.merge_word_boxes(words).where("page = 1").collect()} == {7, 8}
    assert layout.merge_line_boxes(boxes.limit(0), 500).count() == 0 == layout.merge_word_boxes(boxes.limit(0)).count()


def test_tall_bands_are_cut_at_valleys_again_and_again(spark):
    profile = [9, 9, 9, 1, 9, 9, 9, 2, 9, 9, 9, 9, 0, 9, 9]
    smoothed = spark.createDataFrame([(1, y, float(v)) for y, v in enumerate(profile)], "page int, y int, smoothed double")
    bands = spark.createDataFrame([(1, 0, 11), (1, 13, 14), (1, 20, 21), (2, 0, 30)], "page int, top int, bottom int")
    cut = lambda **kw: sorted(tuple(r) for r in layout.split_tall_bands(bands, smoothed, 3, guard=1, **kw).collect())
    assert cut() == [(1, 0, 2), (1, 4, 6), (1, 8, 11), (1, 13, 14), (1, 20, 21), (2, 0, 30)]
    assert cut(levels=1) == [(1, 0, 2), (1, 4, 11), (1, 13, 14), (1, 20, 21), (2, 0, 30)]
    assert cut(ratio=0.15) == cut(levels=1) and cut(levels=0) == cut(ratio=0.1)
    assert layout.split_tall_bands(bands.limit(0), smoothed, 3).count() == 0


def test_alignment_in_one_gathering_and_by_both_joins(spark):
    expected = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 1, "zz"), (3, 1, "a"), (3, 2, "a"), (5, 1, None)], "line int, label_no int, label string")
    crops = spark.createDataFrame([(1, 9), (1, 4), (2, 1), (3, 1), (4, 1), (5, 1)], "line int, word_index int")
    labels = spark.createDataFrame([("a",), ("b",)], "label string")
    labelled, skipped = datasets.align(expected, crops, labels, ["line"])
    assert sorted(map(tuple, labelled.select("line", "word_index", "label").collect())) == [(1, 4, "a"), (1, 9, "b")]
    want = [(2, 1, 1, "unknown_label"), (3, 2, 1, "crop_count_mismatch"), (4, 0, 1, "crop_count_mismatch"), (5, 1, 1, "unknown_label")]
    assert sorted(map(tuple, skipped.collect())) == want
    plan = labelled._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and plan.count("Join") == 1
    for most in (0, datasets.UNKNOWN_BYTES):
        assert sorted(r["line"] for r in datasets._marked(expected, labels, most).where("unknown").collect()) == [2, 5]


def test_lines_with_unknown_words_are_found_through_a_sieve(spark):
    words = spark.range(4000).select((F.col("id") % 40).alias("doc"), (F.floor(F.col("id") / 400) + 1).cast("int").alias("line"), F.concat(F.lit("w"), "id").alias("label"))
    unknown = spark.createDataFrame([(f"w{n}",) for n in (0, 3, 403, 883, 3999, 9999)], "label string")
    odd = spark.createDataFrame([(50, 2, None), (50, 3, "w3"), (50, 3, "w3"), (50, 4, "w1")], "doc long, line int, label string")
    want = [(0, 1), (3, 1), (3, 2), (3, 3), (39, 10), (50, 2), (50, 3)]
    for most_slots in (1, datasets.SIEVE_SLOTS):  # a sieve of one long lets many others pass
        found = datasets.unknown_lines(words.union(odd), unknown, ["doc", "line"], most_slots)
        assert sorted(map(tuple, found.collect())) == want
    assert datasets.unknown_lines(words, unknown.limit(0), ["doc", "line"]).count() == 0
    members = words.where("doc % 10 = 0").select("label")
    passed = words.where(datasets._sieve(members))
    assert passed.join(members, "label", "left_semi").count() == members.count() and passed.count() < 1.05 * members.count()
    lines = words.union(odd).select("doc", "line").distinct()
    marked = datasets.mark_unknown(lines, datasets.unknown_lines(words.union(odd), unknown, ["doc", "line"]), "doc", "line")
    assert marked.count() == lines.count() and sorted((r["doc"], r["line"]) for r in marked.where("unknown").collect()) == want
    assert marked.where("unknown IS NULL").count() == 0


def test_alignment_of_lists_in_a_row(spark):
    rows = [(1, ["a", "b"], [(2,), (4,)], False), (2, ["zz"], [(2,)], True), (3, ["a", "a"], [(2,)], False), (4, [], [(2,)], False), (5, [], [], False), (6, ["a"], [], True)]
    lines = spark.createDataFrame(rows, "line int, words array<string>, crops array<struct<word_index:int>>, unknown boolean")
    labelled, skipped = datasets.align_lists(lines, ["line"])
    assert sorted(map(tuple, labelled.select("line", "word_index", "label").collect())) == [(1, 2, "a"), (1, 4, "b")]
    assert sorted(map(tuple, skipped.collect())) == [(2, 1, 1, "unknown_label"), (3, 2, 1, "crop_count_mismatch"), (4, 0, 1, "crop_count_mismatch"), (6, 1, 0, "crop_count_mismatch")]
    assert tuple(datasets.alignment_summary(labelled, skipped).first()) == (2, 2, 4)


def _rows_shuffled(spark, run) -> int:
    context = spark.sparkContext
    none = spark._jvm.java.util.ArrayList()

    def written() -> int:
        context._jsc.sc().listenerBus().waitUntilEmpty()
        stages = context._jsc.sc().statusStore().stageList(none, False, False, context._gateway.new_array(spark._jvm.double, 0), none)
        return sum(s.shuffleWriteRecords() for s in spark._jvm.scala.jdk.javaapi.CollectionConverters.asJava(stages))

    before = written()
    run()
    return written() - before


@pytest.mark.parametrize("name", ["alignment_summary", "labelled_crops"])
def test_lines_are_aligned_without_a_shuffle_of_their_words(spark, sf, tmp_path, monkeypatch, name):
    """As with a vocabulary over all bounds on what is broadcast."""
    documents = bindings.table(spark, sf, "documents")
    documents.crossJoin(spark.range(8).select((F.col("id") * 1_000_000).alias("shift"))).withColumn("doc_id", F.col("doc_id") + F.col("shift")).drop("shift").write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(datasets._marked, "__defaults__", (0,))
    words = plans.QUERIES["labelled_crops"](spark, str(tmp_path)).count()
    most = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        assert _rows_shuffled(spark, lambda: plans.QUERIES[name](spark, str(tmp_path)).write.format("noop").mode("overwrite").save()) < words
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", most)


def test_words_are_counted_before_they_meet_the_labels(spark):
    words = spark.createDataFrame([("a",), ("x",), ("x",), (None,)], "label string")
    counts = datasets.unknown_label_counts(words, spark.createDataFrame([("a",)], "label string"))
    assert sorted(map(tuple, counts.collect()), key=str) == [("x", 2), (None, 1)]
    plan = counts._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("Join") < plan.index("Aggregate")


def test_items_of_one_task_are_dealt_out_before_they_are_repeated(spark):
    items = spark.createDataFrame([(f"p{i}", "demo") for i in range(40)], "path string, source string").coalesce(1)
    copies = datasets.oversample(items)
    assert len({r["t"] for r in copies.select(F.spark_partition_id().alias("t")).distinct().collect()}) > 1
    assert copies.count() == copies.distinct().count() == 40 * 20


def test_numbers_in_the_order_of_a_hash(spark):
    long = [(F.xxhash64("id") if i else F.lit(None).cast("long")) for i in (0, 1)]
    rows = spark.range(3000).select(F.when(F.col("id") % 50 == 0, long[0]).when(F.col("id") % 7 == 0, F.lit(-5).cast("long")).otherwise(long[1]).alias("h"), (-F.col("id")).alias("id"), (F.col("id") % 3).alias("k"))
    short = F.when(F.col("k") == 0, F.unhex(F.md5(F.col("id").cast("string")))).when(F.col("id") % 2 == 0, F.unhex(F.lit("01"))).when(F.col("id") % 5 == 0, F.unhex(F.lit(""))).otherwise(F.unhex(F.lit("0102")))
    for made in (rows, rows.withColumn("h", short), rows.withColumn("h", F.hex(short)), rows.withColumn("h", F.lit(1).cast("long"))):
        for rows_a_range in (1_000_000, 300):  # the last falls back on sampled borders where a hash is too common
            got = evaluation.number_hashed(made, ["h", "id"], "n", rows_a_range=rows_a_range)
            assert got.columns == ["h", "id", "k", "n"]
            plain = made.withColumn("n", F.row_number().over(Window.orderBy("h", "id")).cast("long"))
            assert got.exceptAll(plain).count() == 0 and got.count() == 3000
    assert evaluation.number_hashed(rows.limit(0), ["h", "id"]).count() == 0
    assert not [f for f in evaluation.number_hashed(rows, ["h", "id"]).inputFiles() if "-ranges-" in f]
