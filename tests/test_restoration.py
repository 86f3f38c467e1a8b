"""Restoration of words and array operators on small inputs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from quirefold.operators import raster
from quirefold.operators import restoration as rs

WORDS = "doc_id long, page int, word_no int, text string, alternative string, confidence double, x0 double, y0 double, x1 double, y1 double, line_id array<int>"


def words(spark, rows):
    """rows: text, alternative, x0, x1, line"""
    return spark.createDataFrame([(1, 0, i, t, a, 0.9, float(x), 0.0, float(y), 12.0, [0, ln]) for i, (t, a, x, y, ln) in enumerate(rows)], WORDS)


def test_option_labels_and_bullets(spark):
    w = words(spark, [("a)", None, 0, 8, 0), ("6)", None, 50, 58, 0), ("B)", None, 90, 98, 0), ("6)", None, 0, 8, 1), ("7)", None, 50, 58, 1), ("e", None, 0, 8, 2), ("Item", None, 30, 60, 2), ("e", None, 0, 8, 3), ("mail", None, 9, 40, 3)])
    assert {r["word_no"]: r["label"] for r in rs.option_labels(w).collect()} == {0: "а)", 1: "б)", 2: "в)"}
    assert [r["word_no"] for r in rs.bullets(w).collect()] == [5]


def test_similarity_spellings_halves(spark):
    pairs = spark.createDataFrame([("hello", "hallo"), ("Same", "same"), ("a", None)], "a string, b string")
    assert [round(r["ratio"], 2) for r in rs.similarity(pairs, "a", "b").orderBy("a").collect()] == [1.0, 0.0, 0.8]
    got = {r["word"]: r["spelling"] for r in rs.cyrillic_spellings(spark.createDataFrame([("oʻqish",), ("eshik",), ("cwx",), (None,)], "word string")).collect()}
    assert got == {"oʻqish": "ўқиш", "eshik": "эшик"}
    w = words(spark, [("foot", "football", 0, 20, 0), ("ball", None, 22, 40, 0), ("x", "", 50, 60, 0)])
    assert [(r["word_no"], r["after_no"]) for r in rs.halves(w).collect()] == [(0, 1)]


def test_restored(spark):
    rows = [
        ("Officc", "Officc"), ("office", "office"), ("leose", "lease"), ("zzzzq", "qqqqz"), ("Velmore", "Velmora"), ("well-knovn", "well-knovn"), ("xx-knovn", None), ("(offlce),", None), ("leas", None), ("known", None), (None, "x"), ("17", None),
    ]
    cyr = [("Договор", None), ("закрыт", None), ("CОТА", None), ("COTA", None)]
    w = spark.createDataFrame(
        [(1, 0, i, t, a, [1, 0], 0.9, 0.0, 0.0, 9.0, 9.0) for i, (t, a) in enumerate(rows)] + [(1, 1, i, t, a, [1, 1], 0.9, 0.0, 0.0, 9.0, 9.0) for i, (t, a) in enumerate(cyr)],
        "doc_id long, page int, word_no int, text string, alternative string, line_id array<int>, confidence double, x0 double, y0 double, x1 double, y1 double",
    )
    lex = spark.createDataFrame([("en", x, "base") for x in ("office", "lease", "well", "known", "сота", "договор", "закрыт")], "lang string, word string, source string")
    got = {r["text"]: (r["restored"], r["how"]) for r in rs.restored(w, lex).collect()}
    assert got == {
        "Officc": ("Office", "word list"), "leose": ("lease", "second reading"), "well-knovn": ("well-known", "word list"), "xx-knovn": ("xx-known", "word list"), "(offlce),": ("(office),", "word list"), "leas": ("lease", "word list"),
        "CОТА": ("СОТА", "alphabet"), "COTA": ("СОТА", "alphabet"),
    }
    assert rs.restored(w.limit(0), lex).count() == 0


@pytest.mark.parametrize("word,model,want", [("office", "OFFICC", "OFFICE"), ("office", "Officc", "Office"), ("office", "officc", "office"), ("a", "B", "A")])
def test_case_like(spark, word, model, want):
    df = spark.createDataFrame([(word, model)], "w string, m string").select(rs.case_like(F.col("w"), F.col("m")).alias("x"))
    assert df.first()["x"] == want


def test_merged_boxes(spark):
    b = spark.createDataFrame([(1, 0, i, float(10 * i), 0.0, float(10 * i + 8), 5.0) for i in (1, 2, 3, 9, 10)] + [(1, 1, 1, 0.0, 0.0, 5.0, 5.0)], "doc_id long, page int, id long, x0 double, y0 double, x1 double, y1 double")
    assert sorted((r["page"], r["id"], r["label"]) for r in rs.merged_boxes(b).collect()) == [(0, 1, 1), (0, 2, 1), (0, 3, 1), (0, 9, 9), (0, 10, 9), (1, 1, 1)]


def brute_components(ink):
    seen, n = np.zeros(ink.shape, int), 0
    for y, x in zip(*np.nonzero(ink)):
        if seen[y, x]:
            continue
        n += 1
        todo = [(y, x)]
        while todo:
            a, b = todo.pop()
            if 0 <= a < ink.shape[0] and 0 <= b < ink.shape[1] and ink[a, b] and not seen[a, b]:
                seen[a, b] = n
                todo += [(a + i, b + j) for i in (-1, 0, 1) for j in (-1, 0, 1)]
    return seen


def test_components_match_flood_fill():
    rng = np.random.default_rng(0)
    for share in (0.1, 0.3, 0.5, 0.7):
        ink = rng.random((25, 30)) < share
        assert (raster.components(ink) == brute_components(ink)).all()
    assert raster.components(np.zeros((3, 4), bool)).max() == 0


def test_raster_measures(spark):
    gray = np.full((60, 90), 250, np.uint8)
    gray[10:20, 5:30] = 20
    gray[10:20, 60:85] = 20
    t = raster.otsu(gray)
    ink = gray <= t
    assert 20 <= t < 250 and raster.gutters(ink) == [(30, 60)] and raster.skew(ink) == 0.0
    assert raster.covered_share(ink, [(5, 10, 30, 20)]) == 0.5 and raster.uncovered(ink, [(5, 10, 30, 20)]) == [(60, 10, 85, 20, 250)]
    turned = np.zeros((120, 200), bool)
    for y in (30, 60, 90):
        for x in range(10, 190):
            turned[int(y + (x - 100) * np.tan(np.radians(4.0))), x] = True
    assert raster.skew(turned) == pytest.approx(4.0, abs=0.5)
    pages = spark.createDataFrame([(1, 0, 90, 60, bytearray(gray.tobytes())), (1, 1, 4, 4, bytearray(b"\xff" * 16))], "doc_id long, page int, width int, height int, gray binary")
    got = {r["page"]: (r["components"], r["gutters"]) for r in raster.page_measures(pages).collect()}
    assert got == {0: (2, 1), 1: (0, 0)}
