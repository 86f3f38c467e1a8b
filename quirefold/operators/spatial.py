"""Joins of boxes. All have the page as equi-key and the geometry as residual condition, so they run as
hash or sort-merge joins whose candidate pairs stay inside a page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.functions.geometry import centre_x, contains_centre, height, x_overlap, y_overlap

PAGE = ["doc_id", "page"]


def prefixed(df: DataFrame, prefix: str, keep: tuple[str, ...] = PAGE) -> DataFrame:
    """The columns with a prefix, but for the page key."""
    return df.select(*keep, *[F.col(c).alias(f"{prefix}{c}") for c in df.columns if c not in keep])


def inside(words: DataFrame, boxes: DataFrame, prefix: str = "b_") -> DataFrame:
    """Words with every box of their page that holds their centre."""
    return words.join(prefixed(boxes, prefix), PAGE).where(contains_centre(prefix))


def outside(words: DataFrame, boxes: DataFrame) -> DataFrame:
    """Words whose centre no box of their page holds."""
    b = boxes.select(*[F.col(c).alias(f"b_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page") == F.col("b_page"))
    return words.join(b, same & contains_centre("b_"), "left_anti")


def second_readings(words: DataFrame, others: DataFrame) -> DataFrame:
    """Words with the text that another reading found in the same place, joined from left to right."""
    o = prefixed(others.select(*PAGE, "word_no", "text", "x0", "y0", "x1", "y1"), "o_")
    slack = 0.15 * height()
    hit = centre_x("o_").between(F.col("x0") - slack, F.col("x1") + slack) & (y_overlap("", "o_") > 0.5 * F.least(height(), height("o_")))
    w = words.select(*PAGE, "word_no", "text", "x0", "y0", "x1", "y1")
    found = w.join(o, PAGE).where(hit).groupBy(*PAGE, "word_no", "text").agg(F.sort_array(F.collect_list(F.struct("o_x0", "o_word_no", "o_text"))).alias("s"))
    return found.select(*PAGE, "word_no", "text", F.array_join(F.transform("s", lambda x: x["o_text"]), "").alias("second"))


def without_repeats(words: DataFrame) -> DataFrame:
    """Words that don't coincide with an earlier word of another line key or text layer: neither holds
    the centre of the other."""
    e = words.select(*[F.col(c).alias(f"e_{c}") for c in (*PAGE, "word_no", "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("e_doc_id")) & (F.col("page") == F.col("e_page")) & (F.col("e_word_no") < F.col("word_no"))
    return words.join(e, same & (contains_centre("e_") | contains_centre("", "e_")), "left_anti")


def near(words: DataFrame, fields: DataFrame, heights: float = 2.0, share: float = 0.3) -> DataFrame:
    """Words beside a field: on its line by `share` of the lower height and at most so many heights away."""
    f = fields.select(*[F.col(c).alias(f"f_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("f_doc_id")) & (F.col("page") == F.col("f_page"))
    return words.join(f, same & (y_overlap("", "f_") > share * F.least(height(), height("f_"))) & (-x_overlap("", "f_") <= heights * height()), "left_semi")


def crossed(words: DataFrame, marks: DataFrame) -> DataFrame:
    """Words that a graphic mark overlaps with positive area."""
    m = marks.select(*[F.col(c).alias(f"m_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("m_doc_id")) & (F.col("page") == F.col("m_page"))
    return words.join(m, same & (y_overlap("", "m_") > 0) & (x_overlap("", "m_") > 0), "left_semi")


def in_slots(boxes: DataFrame, slots: DataFrame, tolerance: float = 1.0) -> DataFrame:
    """Boxes with the slots that hold their centre, and how many slots they overlap."""
    s = prefixed(slots.select(*PAGE, "slot_no", "x0", "x1"), "s_")
    return boxes.join(s, PAGE).where(centre_x().between(F.col("s_x0") - tolerance, F.col("s_x1") + tolerance))


def first_style(words: DataFrame, spans: DataFrame, order: Column) -> DataFrame:
    """Words with the style of the first span that holds their centre."""
    hit = inside(words, spans, "b_")
    return hit.groupBy(*PAGE, "word_no").agg(F.min(F.struct(order.alias("k"), F.col("b_bold").alias("bold"), F.col("b_italic").alias("italic"), F.col("b_size").alias("size"))).alias("s"))
