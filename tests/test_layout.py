"""Lines, segments, slots, paragraphs, lists and rows on small pages."""

from pyspark.sql import functions as F

from quirefold.operators import layout as lay
from quirefold.operators import spatial as sp

WORDS = "doc_id long, page int, word_no int, text string, x0 double, y0 double, x1 double, y1 double, confidence double, size double, bold boolean, italic boolean, underline boolean, line_id array<int>, source_region string"


def words(spark, rows):
    """rows: text, x0, x1, y, line, and size where it differs from 11."""
    full = [(1, 0, i, t, float(a), float(y), float(b), float(y + 12), 0.9, float(rest[0] if rest else 11), False, False, False, [0, ln], "ocr") for i, (t, a, b, y, ln, *rest) in enumerate(rows)]
    return spark.createDataFrame(full, WORDS)


def test_lines_weight_by_characters(spark):
    w = words(spark, [("abcd", 0, 20, 0, 0), ("e", 25, 30, 0, 0)]).withColumn("confidence", F.when(F.col("text") == "e", 0.4).otherwise(0.9))
    r = lay.lines(w).first()
    assert (r["text"], r["confidence"], r["n_words"], r["weight"]) == ("abcd e", 0.8, 2, 5)


def test_segments_and_list_markers(spark):
    w = words(spark, [("1.", 0, 8, 0, 0), ("Item", 60, 90, 0, 0), ("Left", 0, 30, 20, 1), ("right", 200, 240, 20, 1)])
    got = {r["text"]: r["segment_no"] for r in lay.segments(w).collect()}
    assert got == {"1.": 0, "Item": 0, "Left": 0, "right": 1}


def test_slots_merge_overlaps(spark):
    w = words(spark, [("a", 48, 230, 0, 0), ("b", 340, 540, 0, 0), ("c", 50, 233, 16, 1), ("d", 541, 560, 16, 1)])
    assert sorted((r["x0"], r["x1"], r["n"]) for r in lay.slots(w).collect()) == [(48.0, 233.0, 2), (340.0, 560.0, 2)]


def test_paragraphs_of_spaced_lines(spark):
    w = words(spark, [("Review", 48, 490, 60, 0, 18), ("First paragraph.", 48, 490, 100, 1), ("Second paragraph.", 48, 490, 145, 2)])
    got = [r["text"] for r in lay.paragraphs_by_window(lay.lines(w)).orderBy("paragraph_no").collect()]
    assert got == ["Review", "First paragraph.", "Second paragraph."]
    flow = {r["paragraph_no"] for r in lay.flow_paragraphs(lay.lines(w)).collect()}
    assert len(flow) == 3


def test_wrapped_lines_stay_together(spark):
    w = words(spark, [("The inter-", 48, 500, 100, 0), ("national standard", 48, 500, 116, 1), ("ends.", 48, 90, 132, 2)])
    r = lay.paragraphs_by_window(lay.lines(w), pitch=0.9).collect()
    assert len(r) == 1 and r[0]["text"] == "The international standard ends."
    assert len({x["paragraph_no"] for x in lay.flow_paragraphs(lay.lines(w)).collect()}) == 1


def test_list_levels(spark):
    rows = [(1, 0, i, "paragraph", k, x, float(100 + 20 * i), 11.0) for i, (k, x) in enumerate([("list_item", 48.0), ("list_item", 72.0), ("list_item", 48.0), ("paragraph", 48.0), ("list_item", 48.0)])]
    b = spark.createDataFrame(rows, "doc_id long, page int, block_no int, block_type string, kind string, x0 double, y0 double, size double")
    got = [(r["block_no"], r["list_no"]) for r in lay.list_groups(b).orderBy("block_no").collect()]
    assert got == [(0, 1), (1, 1), (2, 1), (4, 2)]


def test_visual_rows_and_grids(spark):
    w = words(spark, [("a", 50, 100, 0, 0), ("b", 240, 300, 1, 1), ("c", 50, 100, 20, 2), ("d", 240, 300, 21, 3)])
    segs = lay.segments(w).groupBy("doc_id", "page", "line_key", "segment_no").agg(F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    assert sorted(r["row_no"] for r in lay.visual_rows(segs).collect()) == [0, 0, 1, 1]
    cells = spark.createDataFrame([(1, 0, r, 50.0 + 190 * c) for r in range(4) for c in range(3)], "doc_id long, page int, row_no int, x0 double")
    assert lay.grid_rows(cells).first()[2:] == (4, 3)


def test_words_outside_and_inside(spark):
    w = words(spark, [("in", 50, 60, 100, 0), ("out", 50, 60, 400, 1)])
    box = spark.createDataFrame([(1, 0, 7, 40.0, 90.0, 520.0, 200.0)], "doc_id long, page int, block_no int, x0 double, y0 double, x1 double, y1 double")
    assert [r["text"] for r in sp.outside(w, box).collect()] == ["out"]
    assert [r["text"] for r in sp.inside(w, box).collect()] == ["in"]
    assert "CartesianProduct" not in sp.outside(w, box)._jdf.queryExecution().toString()


def test_second_reading_joins_pieces(spark):
    w = words(spark, [("hello", 0, 50, 0, 0)])
    o = words(spark, [("hel", 0, 25, 0, 0), ("lo", 26, 50, 1, 0), ("far", 300, 320, 0, 0)])
    assert sp.second_readings(w, o).first()["second"] == "hello"


def test_empty_pages(spark):
    w = words(spark, [("a", 0, 1, 0, 0)]).limit(0)
    assert lay.lines(w).count() == lay.segments(w).count() == lay.slots(w).count() == lay.flow_paragraphs(lay.lines(w)).count() == 0

