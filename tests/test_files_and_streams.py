"""Scans, writers and streams over files made here."""

import json
import os

from pyspark.sql import Window
from pyspark.sql import functions as F

from quillmark import plans
from quillmark.operators import datasets, recognition
from quillmark.sources import files, sinks
from quillmark.streaming import arrivals



def make(root, *names, content=b"x"):
    for name in names:
        path = os.path.join(root, name)
        os.makedirs(os.path.dirname(path), exist_ok=True)
        with open(path, "wb") as f:
            f.write(content)


def test_image_scans(spark, tmp_path):
    make(tmp_path, "in/b.PNG", "in/a.jpg", "in/notes.txt", "ds/court/1.png", "ds/_skip/2.png", "flat/court.png", "flat/odd.png")
    pages = files.page_images(spark, f"{tmp_path}/in").orderBy("page_number").collect()
    assert [(p["page_number"], p["path"][-5:]) for p in pages] == [(1, "a.jpg"), (2, "b.PNG")]
    assert [r["label"] for r in files.class_folders(spark, f"{tmp_path}/ds").collect()] == ["court"]
    assert files.class_folders(spark, f"{tmp_path}/ds", f"{tmp_path}/ds/_skip").count() == 2
    known, unknown = files.flat_files(spark, f"{tmp_path}/flat", spark.createDataFrame([("court",)], "label string"))
    assert [r["label"] for r in known.collect()] == ["court"] and [r["label"] for r in unknown.collect()] == ["odd"]
    assert files.first_sources(files.page_images(spark, f"{tmp_path}/in"), 1).first()["path"].endswith("a.jpg")


def test_listings_from_an_inventory(spark):
    listing = spark.createDataFrame([("s/b/2.png",), ("s/b/10.TIFF",), ("s/a/1.jpg",), ("s/a/1.jpg.txt",), ("s/a/png",), (None,)], "path string")
    assert sorted(tuple(r) for r in files.images_in(listing).select("path", "page_number").collect()) == [("s/a/1.jpg", 1), ("s/b/10.TIFF", 1), ("s/b/2.png", 2)]
    known, unknown = files.labelled_by_stem(listing, spark.createDataFrame([("2",), ("1",), ("1",), (None,)], "label string"))
    assert sorted(r["path"] for r in known.collect()) == ["s/a/1.jpg", "s/b/2.png"] and [r["label"] for r in unknown.collect()] == ["10"]
    crops = spark.createDataFrame([("Page_3/line_1_word_2.png",), ("line_4_word_5.png",), ("Page_3/line_x_word_2.png",), (None,)], "path string")
    assert sorted((r["page"] or 0, r["line"], r["word"]) for r in files.crops_in(crops).collect()) == [(0, 4, 5), (3, 1, 2)]
    assert files.images_in(listing.limit(0)).count() == 0 == files.crops_in(crops.limit(0)).count()


def test_undecodable_images_are_reported(spark, tmp_path):
    make(tmp_path, "img/bad.webp")
    pixels, rejected = files.page_pixels(spark, f"{tmp_path}/img")
    assert pixels.count() == 0 and rejected.count() == 1


def test_pixels(spark, tmp_path):
    import struct
    import zlib

    def chunk(kind, data):
        return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

    rows = b"".join(b"\x00" + bytes(r) for r in ((0, 255, 7), (9, 200, 50)))
    make(tmp_path, "img/p.png", content=b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", 3, 2, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(rows)) + chunk(b"IEND", b""))
    pixels, rejected = files.page_pixels(spark, f"{tmp_path}/img")
    assert [(p["y"], p["x"], p["value"]) for p in pixels.orderBy("y", "x").collect()] == [(0, 0, 0), (0, 1, 255), (0, 2, 7), (1, 0, 9), (1, 1, 200), (1, 2, 50)] and rejected.count() == 0


def test_label_and_transcript_scans(spark, tmp_path):
    make(tmp_path, "labels.txt", content=b"b\r\n\n a_c \nd\n")
    assert [tuple(r) for r in files.label_list(spark, f"{tmp_path}/labels.txt").collect()] == [(0, "b"), (1, "a_c"), (2, "d")]
    make(tmp_path, "t.json", content=json.dumps({"pages": [{"page": 2, "lines": ["x", "y"]}, {"page": 1, "lines": []}]}, indent=1).encode())
    assert [tuple(r) for r in files.expected_lines(spark, f"{tmp_path}/t.json").collect()] == [(2, 1, "x"), (2, 2, "y")]


def test_box_crop_and_report_scans(spark, tmp_path):
    make(tmp_path, "d/Page_0007/line_boxes.csv", content=b"line_index,x,y,w,h\n1,2,3,4,5\nbad,row,x,y,z\n2,1,1,1,1\n")
    boxes = files.line_boxes(spark, f"{tmp_path}/d")
    assert sorted(tuple(r) for r in boxes.collect()) == [(7, 1, 2, 3, 4, 5), (7, 2, 1, 1, 1, 1)]
    joined = files.expected_with_boxes(spark.createDataFrame([(7, 1, "t"), (7, 3, "u")], "page int, line int, text string"), boxes)
    assert sorted((r["line"], r["x"]) for r in joined.collect() if r["x"]) == [(1, 2)] and joined.count() == 2
    make(tmp_path, "c/Page_0002/word_crops/line_003_word_011.png", "c/Page_0002/word_crops/other.png")
    assert [tuple(r)[1:] for r in files.word_crops(spark, f"{tmp_path}/c").collect()] == [(2, 3, 11)]
    make(tmp_path, "r.csv", content=b"no,image_file,true_label,predicted_label,confidence_percent,top1_result,top5_result,remarks\n1,a.png,a,b,50.00,No,Yes,x\n")
    assert files.prediction_report(spark, f"{tmp_path}/r.csv").first()["predicted_label"] == "b"


def test_report_and_label_writers(spark, tmp_path):
    rows = spark.createDataFrame([("a.png", ["a", "b"], "Yes", "Yes"), ("b.png", ["c"], "No", "Yes"), ("c.png", None, "No", "No")], "image_file string, top5 array<string>, top1_result string, top5_result string")
    summary = sinks.write_report(rows, f"{tmp_path}/rep").first()
    assert tuple(summary) == (3, 1, 2, 33.3333, 66.6667) == tuple(spark.read.json(f"{tmp_path}/rep/summary").select(*summary.asDict()).first())
    wrong = spark.read.option("header", "true").csv(f"{tmp_path}/rep/results/top1_result=No")
    assert sorted(r["image_file"] for r in wrong.collect()) == ["b.png", "c.png"]
    assert tuple(sinks.write_report(rows.limit(0), f"{tmp_path}/none").first()) == (0, 0, 0, 0.0, 0.0)
    labels = spark.createDataFrame([("z", 0), ("a", 1)], "label string, label_index int")
    sinks.write_label_list(labels, f"{tmp_path}/labels")
    assert [r["label"] for r in files.label_list(spark, f"{tmp_path}/labels/*.txt").collect()] == ["z", "a"]


def test_box_dataset_and_summary_writers(spark, tmp_path):
    boxes = spark.createDataFrame([(1, 1, 2, 3, 4, 5), (2, 1, 2, 3, 4, 5)], "page int, line_index int, x int, y int, w int, h int")
    sinks.write_boxes(boxes, f"{tmp_path}/boxes")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/boxes").count() == 2
    assert {r["page"]: (r["lines"], r["words"]) for r in sinks.page_summary(boxes, boxes.where("page = 2")).collect()} == {1: (1, 0), 2: (1, 1)}
    first, second = (spark.createDataFrame(rows, "path string, label string") for rows in ([("p", "a"), ("q", "007"), ("r", None)], [("s", "a"), ("t", "a"), ("u", "x/y %")]))
    for items, batch in ((first, "1"), (second, "2"), (second, "2")):
        sinks.append_labelled(items, f"{tmp_path}/ds", batch)
    got = sorted(tuple(map(str, r)) for r in sinks.labelled_items(spark, f"{tmp_path}/ds").select("path", "label", "batch", "sequence_no").collect())
    assert got == [("p", "a", "1", "1"), ("q", "007", "1", "1"), ("r", "None", "1", "1"), ("s", "a", "2", "2"), ("t", "a", "2", "3"), ("u", "x/y %", "2", "1")]
    sinks.append_labelled(first.limit(1), f"{tmp_path}/ds", "1")
    assert sinks.labelled_items(spark, f"{tmp_path}/ds").count() == 6
    spark.createDataFrame([("x/y %+", "v"), ("z", "w")], "label string, value string").write.partitionBy("label").text(f"{tmp_path}/tree")
    assert [tuple(r) for r in files.labelled_lines(spark, f"{tmp_path}/tree", "x*").collect()] == [("x/y %+", "v")]
    objects = spark.createDataFrame([(1, '{"pages":[{"page":3,"lines":["a","b"]},{"page":4,"lines":[]}]}'), (2, '{"pages":[{"page":'), (3, None), (4, "{}")], "k int, o string")
    assert sorted((r["k"], r["page"], r["line"], r["text"], r["broken"]) for r in files.transcript_objects(objects, "o", "k").where("broken IS NULL").collect()) == [(1, 3, 1, "a", None), (1, 3, 2, "b", None)]
    assert [(r["k"], r["broken"]) for r in files.transcript_objects(objects, "o", "k").where("broken IS NOT NULL").collect()] == [(2, '{"pages":[{"page":')]
    summary = spark.createDataFrame([("a", 3, 1, 1, 1)], "label string, total long, train long, val long, test long")
    sinks.write_json(sinks.split_summary_document(summary, spark.createDataFrame([("s", "a", 3)], "source string, label string, n long")), f"{tmp_path}/sum")
    assert spark.read.json(f"{tmp_path}/sum").first()["label_counts"]["a"] == 3
    crops = spark.createDataFrame([("f", "l", 1, 1, 1, 0, 0, 1, 1, "s", "t")], "image_file string, label string, page int, line int, word_position int, x1 int, y1 int, x2 int, y2 int, source_image string, transcript string")
    sinks.write_manifest(crops, f"{tmp_path}/m")
    assert spark.read.option("header", "true").csv(f"{tmp_path}/m").count() == 1


def test_transcript_writers(spark, tmp_path):
    out = sinks.write_transcripts(spark.createDataFrame([("b1", " hello \n"), ("b2", None), ("b3", "x\r\ny")], "batch_id string, transcript_text string"), f"{tmp_path}/t")
    assert out.orderBy("batch_id").first()["saved_location"] == f"{tmp_path}/t/batch_id=b1"
    assert sorted(tuple(r) for r in files.transcript_files(spark, f"{tmp_path}/t").collect()) == [("b1", "hello\n"), ("b2", "\n"), ("b3", "x\r\ny\n")]
    lines = spark.createDataFrame([("b", 1, 1, "x")], "batch_id string, page_no int, line_no int, text string")
    sinks.write_export(lines, f"{tmp_path}/e")
    assert spark.read.parquet(f"{tmp_path}/e").count() == 1


def test_transcripts_of_many_batches_lie_in_few_files(spark, tmp_path):
    rows = [(f"b{i}", f" text {i} \n") for i in range(400)] + [("b/=#", "x\r\ny"), ("twice", "one"), ("twice", None), (None, "no key")]
    batches = spark.createDataFrame(rows, "batch_id string, transcript_text string").repartition(3)
    out = sinks.save_transcripts(batches, f"{tmp_path}/t")
    assert {r["saved_location"] for r in out.where("batch_id = 'b7'").collect()} == {f"{tmp_path}/t#b7"}
    got = [tuple(r) for r in files.saved_transcripts(spark, f"{tmp_path}/t").collect()]
    assert sorted(got, key=str) == sorted([(k, (t or "").strip() + "\n") for k, t in rows], key=str)
    assert sum(name.startswith("part-") for name in os.listdir(f"{tmp_path}/t")) == 3


def test_saved_transcripts_query_plans_no_folder_a_document(spark, sf):
    inputs = plans.QUERIES["transcripts_saved"](spark, sf).inputFiles()
    assert 0 < len(inputs) <= 4



def test_streams_equal_the_batch(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(3):
        events.orderBy("ts", "event_id").withColumn("r", F.ntile(3).over(Window.orderBy("ts", "event_id"))).where(F.col("r") == i + 1).drop("r").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    source = arrivals.read_arrivals(spark, f"{tmp_path}/in")
    arrivals.store_arrivals(source, f"{tmp_path}/store", f"{tmp_path}/c1").awaitTermination()
    stored = spark.read.parquet(f"{tmp_path}/store")
    assert stored.select("version").distinct().count() == 3 and stored.count() == events.count()
    sizes = stored.groupBy("batch_id").agg(F.count("*").alias("n"), F.max("page_number").alias("m"), F.countDistinct("page_number").alias("d"))
    assert sizes.where("n <> m OR n <> d").count() == 0
    arrivals.store_arrivals(source, f"{tmp_path}/store", f"{tmp_path}/c1").awaitTermination()
    assert spark.read.parquet(f"{tmp_path}/store").count() == events.count()
    counts = spark.read.parquet(f"{tmp_path}/store-counts/version=2")
    assert counts.agg(F.sum("have")).first()[0] == events.count()
    arrivals.store_counters(source, f"{tmp_path}/counters", f"{tmp_path}/c2").awaitTermination()
    rounded = lambda df: {(r["batch_id"], r["pages"], round(r["confidence_sum"], 4), r["low_words"]) for r in df.collect()}
    assert rounded(arrivals.latest_counters(spark, f"{tmp_path}/counters")) == rounded(arrivals.running_counters(arrivals.as_pages(events)))


def test_prototype_bound(spark, monkeypatch):
    import pytest

    monkeypatch.setattr(recognition, "MAX_PROTOTYPE_VALUES", 1)
    with pytest.raises(ValueError, match="prototype values"):
        recognition.fit_prototypes(spark.createDataFrame([("a", [1.0, 2.0])], "label string, embedding array<double>"))


def test_first_saved_model(spark, tmp_path):
    import pytest

    train = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.0, 1.0])], "label string, embedding array<double>")
    recognition.prototypes(train).write.parquet(f"{tmp_path}/model")
    make(tmp_path, "labels.txt", content=b"b\na\n")
    make(tmp_path, "more.txt", content=b"b\na\nz\n")
    gone, whole = (f"{tmp_path}/model", f"{tmp_path}/gone.txt"), (f"{tmp_path}/model", f"{tmp_path}/labels.txt")
    model = recognition.first_saved_model(spark, [gone, (f"{tmp_path}/none", f"{tmp_path}/labels.txt"), whole])
    assert model.names == ["b", "a"] and model.matrix.tolist() == [[0.0, 1.0], [1.0, 0.0]]
    with pytest.raises(FileNotFoundError):
        recognition.first_saved_model(spark, [gone])
    with pytest.raises(ValueError, match="'z'"):
        recognition.first_saved_model(spark, [(f"{tmp_path}/model", f"{tmp_path}/more.txt")])


def test_bad_rows_are_found_by_halves(spark):
    def scorer(rows):
        if (rows["x"] == 7).any():
            raise ValueError("seven")
        return rows["x"].map(lambda x: [float(x)])

    out = {r["id"]: (r["scores"], r["error"]) for r in recognition.score(spark.range(20).withColumn("x", F.col("id")), lambda: scorer, key="id", features=["x"]).collect()}
    assert out == {i: ([float(i)], None) if i != 7 else (None, "ValueError: seven") for i in range(20)}
