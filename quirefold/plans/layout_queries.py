"""Queries over words, lines, segments, slots, paragraphs and lists, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions import geometry as g
from quirefold.functions.text import LIST_PREFIX, count_of, fold_lines
from quirefold.operators import layout as lay
from quirefold.session import table

PAGE = lay.PAGE
Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


# ---- SQL pieces -----------------------------------------------------------------------------------
R = lambda x, k=10000: f"floor(({x}) * {k}.0 + 0.5) / {k}.0"
KEYED = """keyed AS (SELECT *, CASE WHEN len(line_id) > 0 THEN array_to_string(line_id, '-')
  ELSE 'y' || round_even(y0 / 4, 0)::INT END AS line_key FROM words WHERE text IS NOT NULL)"""
LINES = f"""{KEYED}, lines AS (SELECT doc_id, page, line_key, count(*) AS n_words, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1,
  max(y1) AS y1, median(size) AS size, sum(greatest(1, length(text)))::BIGINT AS weight,
  {R("sum(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END * greatest(1, length(text))) / sum(greatest(1, length(text)))")} AS confidence,
  {R("sum(CASE WHEN bold THEN greatest(1, length(text)) ELSE 0 END) / sum(greatest(1, length(text)))")} AS bold_ratio,
  {R("sum(CASE WHEN italic THEN greatest(1, length(text)) ELSE 0 END) / sum(greatest(1, length(text)))")} AS italic_ratio,
  string_agg(text, ' ' ORDER BY x0, word_no) AS text FROM keyed GROUP BY ALL)"""
MARGINS = """margins AS (SELECT doc_id, page, list_sort(list(x0))[floor(0.2 * (count(*) - 1))::INT + 1] AS left_margin,
  list_sort(list(x1))[floor(0.8 * (count(*) - 1))::INT + 1] AS right_margin FROM lines GROUP BY ALL)"""
SEG = f"""{KEYED}, em AS (SELECT doc_id, page, line_key, greatest(4.0, median(size)) AS em FROM keyed GROUP BY ALL),
 gaps AS (SELECT k.*, e.em, x0 - lag(x1) OVER w AS gap, row_number() OVER w AS k, lag(text) OVER w AS before
  FROM keyed k JOIN em e USING (doc_id, page, line_key) WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no)),
 seg AS (SELECT *, sum(CASE WHEN gap > 2.2 * em AND NOT (k = 2 AND regexp_matches(before, '^([•●▪*\\-–]|\\(?\\d{{1,3}}[.)]|[A-Za-z][.)])$')) THEN 1 ELSE 0 END)
  OVER (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING) AS segment_no FROM gaps)"""


@query(
    "flagship_page_structure",
    f"""WITH {LINES}, {MARGINS}, per AS (SELECT doc_id, page, count(*) AS n_lines, sum(n_words)::BIGINT AS n_words, {R("median(y1 - y0)")} AS line_height,
      {R("median(size)")} AS line_size, {R("sum(confidence * weight) / sum(weight)", 1000)} AS confidence FROM lines GROUP BY ALL),
      s AS (SELECT DISTINCT doc_id, page, n FROM (SELECT doc_id, page, line_key, x0, word_no, size, x1, text FROM keyed) JOIN (SELECT doc_id, page, count(DISTINCT text) AS n FROM keyed GROUP BY ALL) USING (doc_id, page))
      SELECT doc_id, page, n_lines, n_words, n AS n_distinct, line_height, line_size, confidence, left_margin, right_margin FROM per JOIN margins USING (doc_id, page) JOIN s USING (doc_id, page)""",
)
def flagship_page_structure(spark: SparkSession, d: str) -> DataFrame:
    """Words to lines to a report per page."""
    words = table(spark, d, "words")
    lines = lay.lines(words)
    per = lines.groupBy(*PAGE).agg(
        F.count("*").alias("n_lines"),
        F.sum("n_words").alias("n_words"),
        g.rounded(F.median(g.height())).alias("line_height"),
        g.rounded(F.median("size")).alias("line_size"),
        g.rounded(F.sum(F.col("confidence") * F.col("weight")) / F.sum("weight"), 3).alias("confidence"),
        g.index_quantile(F.collect_list("x0"), 0.2).alias("left_margin"),
        g.index_quantile(F.collect_list("x1"), 0.8).alias("right_margin"),
    )
    n = words.groupBy(*PAGE).agg(F.count_distinct("text").alias("n_distinct"))
    return per.join(n, PAGE)


@query(
    "geo_p1_boxes",
    f"""SELECT doc_id, page, count(*) AS n, {R("sum(x1 - x0)", 100)} AS width_sum, {R("max((x1 - x0) * (y1 - y0))", 100)} AS area_max,
    count(*) FILTER (NOT (x0 <= x1 AND y0 <= y1)) AS n_invalid FROM words GROUP BY ALL""",
)
def geo_p1_boxes(spark, d):
    w = table(spark, d, "words")
    return w.groupBy(*PAGE).agg(
        F.count("*").alias("n"),
        g.rounded(F.sum(g.width()), 2).alias("width_sum"),
        g.rounded(F.max(g.area()), 2).alias("area_max"),
        F.count_if(~g.valid_box()).alias("n_invalid"),
    )


@query("geo_g1_line_boxes", f"WITH {KEYED} SELECT doc_id, page, line_key, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM keyed GROUP BY ALL")
def geo_g1_line_boxes(spark, d):
    return lay.with_line(table(spark, d, "words").where("text is not null")).groupBy(*PAGE, "line_key").agg(*g.enclosing())


@query("agg_g2_line_profile", f"WITH {LINES} SELECT doc_id, page, line_key, n_words, size, confidence, bold_ratio, italic_ratio, text FROM lines")
def agg_g2_line_profile(spark, d):
    return lay.lines(table(spark, d, "words")).select(*PAGE, "line_key", "n_words", "size", "confidence", "bold_ratio", "italic_ratio", "text")


@query(
    "agg_g3_style_runs",
    f"""WITH {KEYED}, m AS (SELECT *, CASE WHEN lag(hash(bold, italic, underline, source_region)) OVER w IS NOT DISTINCT FROM hash(bold, italic, underline, source_region) THEN 0 ELSE 1 END AS new
      FROM keyed WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY word_no)),
      r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page, line_key ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS run_no FROM m)
      SELECT doc_id, page, line_key, run_no::BIGINT AS run_no, count(*) AS n_words, min(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END) AS confidence,
      string_agg(text, ' ' ORDER BY word_no) AS text FROM r GROUP BY doc_id, page, line_key, run_no""",
)
def agg_g3_style_runs(spark, d):
    return lay.style_runs(table(spark, d, "words"))


@query(
    "agg_g4_page_confidence",
    f"SELECT doc_id, page, {R('avg(confidence)', 1000)} AS confidence, count(*) AS n FROM words WHERE NOT isnan(confidence) GROUP BY ALL",
)
def agg_g4_page_confidence(spark, d):
    return table(spark, d, "words").where(~F.isnan("confidence")).groupBy(*PAGE).agg(g.rounded(F.avg("confidence"), 3).alias("confidence"), F.count("*").alias("n"))


@query(
    "agg_g5_body_size",
    """WITH p AS (SELECT doc_id, size, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY size, page, block_no ROWS UNBOUNDED PRECEDING) AS reached,
      sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM blocks WHERE kind = 'paragraph' AND size > 0 AND length(text) > 0)
      SELECT doc_id, round_even(min(size) * 2, 0) / 2 AS body_size FROM p WHERE reached * 2 >= total GROUP BY doc_id""",
)
def agg_g5_body_size(spark, d):
    return lay.body_size(table(spark, d, "blocks"))


@query(
    "agg_g6_ocr_sizes",
    f"""WITH {KEYED} SELECT doc_id, page, line_key, list_sort(list(y1 - y0))[floor(0.8 * (count(*) - 1))::INT + 1] AS tallest,
      greatest(6.0, least(40.0, list_sort(list(y1 - y0))[floor(0.8 * (count(*) - 1))::INT + 1] / 0.9)) AS size
      FROM keyed WHERE source_region LIKE 'ocr%' AND regexp_matches(text, '\\p{{L}}') GROUP BY ALL""",
)
def agg_g6_ocr_sizes(spark, d):
    return lay.ocr_sizes(table(spark, d, "words"))


_ROWS = f"""{LINES}, pages AS (SELECT doc_id, page, max(width) AS width FROM page_plan GROUP BY ALL),
  alone AS (SELECT a.*, NOT EXISTS (SELECT 1 FROM lines b WHERE b.doc_id = a.doc_id AND b.page = a.page AND b.line_key <> a.line_key
    AND least(a.y1, b.y1) - greatest(a.y0, b.y0) > 0.5 * least(a.y1 - a.y0, b.y1 - b.y0)) AS single FROM lines a)"""


@query(
    "agg_g7_margins",
    f"""WITH {_ROWS}, k AS (SELECT a.*, p.width, a.single AND x1 - x0 >= 0.45 * p.width AS wide FROM alone a JOIN pages p USING (doc_id, page))
      SELECT doc_id, page, count(*) FILTER (wide) AS n_wide, {R("list_sort(CASE WHEN count(*) FILTER (wide) > 0 THEN list(x0) FILTER (wide) ELSE list(x0) END)[floor(0.2 * (CASE WHEN count(*) FILTER (wide) > 0 THEN count(*) FILTER (wide) ELSE count(*) END - 1))::INT + 1]")} AS left_margin,
        {R("CASE WHEN count(*) FILTER (wide) > 0 THEN list_sort(list(x1) FILTER (wide))[floor(0.8 * (count(*) FILTER (wide) - 1))::INT + 1] ELSE max(width) - list_sort(list(x0))[floor(0.2 * (count(*) - 1))::INT + 1] END")} AS right_margin
      FROM k GROUP BY ALL""",
)
def agg_g7_margins(spark, d):
    """Text margins by index quantiles over lines that stand alone in their row and are .45 of the page wide; without one, over all lines."""
    width = table(spark, d, "page_plan").groupBy(*PAGE).agg(F.max("width").alias("width"))
    return lay.wide_margins(lay.single_lines(lay.lines(table(spark, d, "words"))).join(width, PAGE))


@query(
    "agg_g8_line_pitch",
    f"""WITH {_ROWS}, gap AS (SELECT *, y1 - y0 AS h, CASE WHEN single AND lag(single) OVER w THEN y0 - lag(y1) OVER w END AS gap FROM alone WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line_key))
      SELECT doc_id, page, {R("coalesce(median(gap) FILTER (gap >= 0), 0.3 * median(h))")} AS pitch FROM gap GROUP BY ALL""",
)
def agg_g8_line_pitch(spark, d):
    """The median gap of consecutive lines that stand alone in their rows."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "x0", "line_key")
    lines = lay.single_lines(lay.lines(table(spark, d, "words"))).withColumn("h", g.height())
    lines = lines.withColumn("gap", F.when(F.col("single") & F.lag("single").over(order), F.col("y0") - F.lag("y1").over(order)))
    gap = F.median(F.when(F.col("gap") >= 0, F.col("gap")))
    return lines.groupBy(*PAGE).agg(g.rounded(F.coalesce(gap, 0.3 * F.median("h"))).alias("pitch"))


@query("win_w1_segments", f"WITH {SEG} SELECT doc_id, page, line_key, segment_no::BIGINT AS segment_no, count(*) AS n_words, min(x0) AS x0, max(x1) AS x1 FROM seg GROUP BY ALL")
def win_w1_segments(spark, d):
    return lay.segments(table(spark, d, "words")).groupBy(*PAGE, "line_key", "segment_no").agg(F.count("*").alias("n_words"), F.min("x0").alias("x0"), F.max("x1").alias("x1"))


@query(
    "win_w2_rtl_order",
    f"""WITH {KEYED} SELECT doc_id, page, line_key, string_agg(text, ' ' ORDER BY x1 DESC, word_no) AS text FROM keyed GROUP BY ALL
      HAVING sum(length(regexp_replace(text, '[^\\p{{Arabic}}]', '', 'g'))) > sum(length(regexp_replace(text, '[^\\p{{Latin}}\\p{{Cyrillic}}\\p{{Han}}]', '', 'g')))""",
)
def win_w2_rtl_order(spark, d):
    """Right-to-left lines in logical order: the right-most word first."""
    w = lay.with_line(table(spark, d, "words").where("text is not null"))
    rtl, ltr = F.sum(count_of(F.col("text"), r"\p{IsArabic}")), F.sum(count_of(F.col("text"), r"[\p{IsLatin}\p{IsCyrillic}\p{IsHan}]"))
    return (
        w.groupBy(*PAGE, "line_key")
        .agg(rtl.alias("rtl"), ltr.alias("ltr"), F.sort_array(F.collect_list(F.struct((-F.col("x1")).alias("k"), "word_no", "text"))).alias("s"))
        .where("rtl > ltr")
        .select(*PAGE, "line_key", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))
    )


@query("win_w3_visual_rows")
def win_w3_visual_rows(spark, d):
    """Greedy rows of segments (rows only: the greedy form has no SQL restatement)."""
    segs = lay.segments(table(spark, d, "words")).groupBy(*PAGE, "line_key", "segment_no").agg(*g.enclosing())
    return lay.visual_rows(segs).groupBy(*PAGE).agg(F.max(F.col("row_no") + 1).alias("n_rows"), F.count("*").alias("n_segments"))


@query(
    "win_w4_list_markers",
    f"""WITH {KEYED}, l AS (SELECT doc_id, page, line_key, text, row_number() OVER w AS k, lead(text) OVER w AS after FROM keyed
      WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no))
      SELECT doc_id, page, line_key, text AS marker, text || ' ' || after AS joined FROM l WHERE k = 1 AND after IS NOT NULL AND regexp_matches(text, '^([•●▪*\\-–]|\\(?\\d{{1,3}}[.)]|[A-Za-z][.)])$')""",
)
def win_w4_list_markers(spark, d):
    line = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumns({"k": F.row_number().over(line), "after": F.lead("text").over(line)})
    return w.where((F.col("k") == 1) & F.col("after").isNotNull() & F.col("text").rlike(lay.LIST_MARKER)).select(
        *PAGE, "line_key", F.col("text").alias("marker"), F.concat_ws(" ", "text", "after").alias("joined")
    )


@query(
    "win_w5_slots",
    """WITH e AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM cells),
      n AS (SELECT *, CASE WHEN edge IS NULL OR x0 > edge + 4.0 THEN 1 ELSE 0 END AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, y0, y1 ROWS UNBOUNDED PRECEDING) AS slot_no FROM n)
      SELECT doc_id, page, slot_no::BIGINT AS slot_no, min(x0) AS x0, max(x1) AS x1, count(*) AS n FROM s GROUP BY doc_id, page, slot_no""",
)
def win_w5_slots(spark, d):
    """Column slots of the table cells of each page."""
    return lay.slots(table(spark, d, "cells"))


@query("win_w7_flow_paragraphs")
def win_w7_flow_paragraphs(spark, d):
    """Paragraphs with tests on the whole paragraph so far (rows only)."""
    return lay.flow_paragraphs(lay.lines(table(spark, d, "words"))).groupBy(*PAGE).agg(F.max("paragraph_no").alias("n_paragraphs"), F.count("*").alias("n_lines"))


@query(
    "win_w8_paragraph_starts",
    f"""WITH {LINES}, {MARGINS}, t AS (SELECT doc_id, page, n_words, y0, CASE WHEN lag(y0) OVER w IS NULL OR y0 - lag(y1) OVER w > 0.75 * greatest(4.0, lag(size) OVER w)
        OR abs(size - lag(size) OVER w) > 0.2 * lag(size) OVER w OR (lag(bold_ratio) OVER w >= 0.6) <> (bold_ratio >= 0.6)
        OR regexp_matches(text, '^\\s*([•●▪*\\-–]|\\(?\\d{{1,3}}[.)]|[A-Za-z][.)])\\s+') OR lag(x1) OVER w < right_margin - 2.5 * greatest(4.0, lag(size) OVER w)
        THEN 1 ELSE 0 END AS starts FROM lines JOIN margins USING (doc_id, page) WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, line_key))
      SELECT doc_id, page, sum(starts)::BIGINT AS n_paragraphs, sum(n_words)::BIGINT AS n_words FROM t GROUP BY ALL""",
)
def win_w8_paragraph_starts(spark, d):
    p = lay.paragraphs_by_window(lay.lines(table(spark, d, "words")))
    return p.groupBy(*PAGE).agg(F.count("*").alias("n_paragraphs"), F.sum("n_words").alias("n_words"))


@query("win_w9_paragraph_text")
def win_w9_paragraph_text(spark, d):
    """Paragraph texts folded from lines with hyphen and script rules (rows only)."""
    return lay.paragraphs_by_window(lay.lines(table(spark, d, "words"))).select(*PAGE, "paragraph_no", "n_lines", "text")


@query(
    "win_w10_list_groups",
    """WITH b AS (SELECT *, coalesce(kind = 'list_item', false) AS item, coalesce(lag(kind = 'list_item') OVER w, false) AS before FROM blocks WHERE block_type = 'paragraph'
        WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, x0, block_no)),
      n AS (SELECT *, sum(CASE WHEN item AND NOT before THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no ROWS UNBOUNDED PRECEDING) AS list_no FROM b),
      f AS (SELECT *, first(x0) OVER (PARTITION BY doc_id, page, list_no ORDER BY y0, x0, block_no) AS base FROM n)
      SELECT doc_id, page, block_no, list_no::BIGINT AS list_no, least(8, greatest(0, floor((x0 - first(x0) OVER (PARTITION BY doc_id, page, list_no ORDER BY y0, x0, block_no) + 4.0) / greatest(18.0, 1.6 * coalesce(size, 12.0)))))::INT AS level_no
      FROM f WHERE item""",
)
def win_w10_list_groups(spark, d):
    b = lay.list_groups(table(spark, d, "blocks"))
    # the base is the first item of the run
    own = Window.partitionBy(*PAGE, "list_no").orderBy("y0", "x0", "block_no")
    step = F.greatest(F.lit(18.0), 1.6 * F.coalesce("size", F.lit(12.0)))
    level = F.least(F.lit(8), F.greatest(F.lit(0), F.floor((F.col("x0") - F.first("x0").over(own) + 4.0) / step))).cast("int")
    return b.withColumn("level_no", level).select(*PAGE, "block_no", "list_no", "level_no")


@query(
    "win_w11_headings",
    """WITH p AS (SELECT doc_id, size, sum(length(text)) OVER (PARTITION BY doc_id ORDER BY size, page, block_no ROWS UNBOUNDED PRECEDING) AS reached,
        sum(length(text)) OVER (PARTITION BY doc_id) AS total FROM blocks WHERE kind = 'paragraph' AND size > 0 AND length(text) > 0),
      body AS (SELECT doc_id, round_even(min(size) * 2, 0) / 2 AS body_size FROM p WHERE reached * 2 >= total GROUP BY doc_id),
      t AS (SELECT b.*, body_size, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no) AS k FROM blocks b JOIN body USING (doc_id) WHERE block_type = 'paragraph')
      SELECT doc_id, page, block_no, kind = 'heading' AS marked, CASE WHEN size >= body_size * 1.35 OR (k = 1 AND size >= body_size * 1.15) THEN 0 ELSE 1 END AS level_no
      FROM t WHERE length(text) < 150 AND (size >= body_size * 1.3 OR (bold AND source_lines <= 2))""",
)
def win_w11_headings(spark, d):
    """Short paragraphs that are larger than the body, or bold and of at most two lines."""
    b = table(spark, d, "blocks").where("block_type = 'paragraph'")
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_no"))
    t = b.withColumn("k", k).join(lay.body_size(table(spark, d, "blocks")), "doc_id")
    large = F.col("size") >= F.col("body_size") * 1.35
    return t.where((F.length("text") < 150) & ((F.col("size") >= F.col("body_size") * 1.3) | (F.col("bold") & (F.col("source_lines") <= 2)))).select(
        *PAGE, "block_no", (F.col("kind") == "heading").alias("marked"), F.when(large | ((F.col("k") == 1) & (F.col("size") >= F.col("body_size") * 1.15)), 0).otherwise(1).alias("level_no")
    )


@query(
    "win_w12_vertical_spacing",
    f"""WITH t AS (SELECT *, y0 - lag(y1) OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no) - 0.2 * coalesce(size, 12.0) AS gap FROM blocks)
      SELECT doc_id, page, block_no, {R("coalesce(greatest(0.0, least(30.0, gap)), 0.0)")} AS space_before FROM t WHERE block_type = 'paragraph'""",
)
def win_w12_vertical_spacing(spark, d):
    return lay.vertical_spacing(table(spark, d, "blocks")).select(*PAGE, "block_no", g.rounded(F.col("space_before")).alias("space_before"))


@query(
    "win_w13_hyphen_joins",
    f"""WITH {KEYED}, l AS (SELECT doc_id, page, word_no, text, line_key, lead(text) OVER w AS after, lead(line_key) OVER w AS after_line FROM keyed WINDOW w AS (PARTITION BY doc_id, page ORDER BY word_no))
      SELECT doc_id, page, word_no, regexp_replace(text, '[-‑¬]+$', '') || after AS joined FROM l
      WHERE regexp_matches(text, '[-‑¬]$') AND line_key <> after_line AND regexp_matches(after, '^\\p{{L}}')""",
)
def win_w13_hyphen_joins(spark, d):
    order = Window.partitionBy(*PAGE).orderBy("word_no")
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumns({"after": F.lead("text").over(order), "after_line": F.lead("line_key").over(order)})
    return w.where(F.col("text").rlike("[-‑¬]$") & (F.col("line_key") != F.col("after_line")) & F.col("after").rlike(r"^\p{L}")).select(
        *PAGE, "word_no", F.concat(F.regexp_replace("text", "[-‑¬]+$", ""), "after").alias("joined")
    )


@query(
    "win_w14_neighbour_scripts",
    f"""WITH {KEYED}, s AS (SELECT doc_id, page, line_key, word_no, x0, CASE WHEN regexp_matches(text, '\\p{{Cyrillic}}') THEN 'C' WHEN regexp_matches(text, '\\p{{Latin}}') THEN 'L' END AS script FROM keyed),
      n AS (SELECT *, coalesce(lag(script, 1) OVER w, lag(script, 2) OVER w) AS l, coalesce(lead(script, 1) OVER w, lead(script, 2) OVER w) AS r FROM s WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no))
      SELECT doc_id, page, word_no, script, l, r FROM n WHERE script IS NOT NULL AND (l IS NOT NULL OR r IS NOT NULL) AND coalesce(l, r) <> script AND coalesce(r, l) <> script""",
)
def win_w14_neighbour_scripts(spark, d):
    """Words of one alphabet between words of the other, looking two words far."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    script = F.when(F.col("text").rlike(r"\p{IsCyrillic}"), "C").when(F.col("text").rlike(r"\p{IsLatin}"), "L")
    s = lay.with_line(table(spark, d, "words").where("text is not null")).withColumn("script", script)
    s = s.withColumns(
        {
            "l": F.coalesce(F.lag("script", 1).over(line), F.lag("script", 2).over(line)),
            "r": F.coalesce(F.lead("script", 1).over(line), F.lead("script", 2).over(line)),
        }
    )
    return s.where(F.col("script").isNotNull() & (F.coalesce("l", "r") != F.col("script")) & (F.coalesce("r", "l") != F.col("script"))).select(*PAGE, "word_no", "script", "l", "r")


@query(
    "win_w17_weak_runs",
    f"""WITH {KEYED}, f AS (SELECT *, coalesce(confidence < 0.75 OR isnan(confidence), false) AS weak, lag(coalesce(confidence < 0.75 OR isnan(confidence), false)) OVER w AS b, lead(coalesce(confidence < 0.75 OR isnan(confidence), false)) OVER w AS a
        FROM keyed WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY word_no)),
      m AS (SELECT *, weak OR (length(text) <= 3 AND coalesce(a, false) AND coalesce(b, false)) AS member FROM f),
      i AS (SELECT *, sum(CASE WHEN member THEN 0 ELSE 1 END) OVER (PARTITION BY doc_id, page, line_key ORDER BY word_no ROWS UNBOUNDED PRECEDING) AS island FROM m)
      SELECT doc_id, page, line_key, min(word_no) AS first_word, count(*) AS n_words,
        CASE WHEN count(*) <= 6 THEN repeat('_', greatest(3, round_even((max(x1) - min(x0)) / (0.5 * max(y1 - y0)), 0))::INT) END AS blank FROM i WHERE member GROUP BY doc_id, page, line_key, island HAVING count(*) >= 2""",
)
def win_w17_weak_runs(spark, d):
    """Runs of two or more weak words, a short word between two of them included, as one blank field; a run of more than six is text and has none."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("word_no")
    weak = F.coalesce((F.col("confidence") < 0.75) | F.isnan("confidence"), F.lit(False))
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumn("weak", weak)
    w = w.withColumn("member", F.col("weak") | ((F.length("text") <= 3) & F.coalesce(F.lead("weak").over(line), F.lit(False)) & F.coalesce(F.lag("weak").over(line), F.lit(False))))
    w = w.withColumn("island", F.sum(F.when(F.col("member"), 0).otherwise(1)).over(line.rowsBetween(Window.unboundedPreceding, 0)))
    n = F.greatest(F.lit(3), F.bround((F.max("x1") - F.min("x0")) / (0.5 * F.max(g.height()))).cast("int"))
    runs = w.where("member").groupBy(*PAGE, "line_key", "island").agg(F.min("word_no").alias("first_word"), F.count("*").alias("n_words"), n.alias("n"))
    return runs.where("n_words >= 2").select(*PAGE, "line_key", "first_word", "n_words", F.expr("CASE WHEN n_words <= 6 THEN repeat('_', n) END").alias("blank"))


@query(
    "win_w19_list_sequence",
    """WITH i AS (SELECT doc_id, page, block_no, y0, TRY_CAST(regexp_extract(text, '^\\s*\\(?(\\d{1,3})[.)]', 1) AS INT) AS n FROM blocks WHERE kind = 'list_item'),
      s AS (SELECT *, lag(n) OVER w AS before, lead(n) OVER w AS after FROM i WHERE n IS NOT NULL WINDOW w AS (PARTITION BY doc_id, page ORDER BY y0, block_no))
      SELECT doc_id, page, block_no, n, coalesce(before = n - 1, false) OR (n = 1 AND coalesce(after = 2, false)) AS confirmed FROM s""",
)
def win_w19_list_sequence(spark, d):
    """List numbers confirmed by the one before, or a 1 followed by a 2."""
    order = Window.partitionBy(*PAGE).orderBy("y0", "block_no")
    i = table(spark, d, "blocks").where("kind = 'list_item'").withColumn("n", F.regexp_extract("text", r"^\s*\(?(\d{1,3})[.)]", 1).try_cast("int")).where("n is not null")
    ok = F.coalesce(F.lag("n").over(order) == F.col("n") - 1, F.lit(False)) | ((F.col("n") == 1) & F.coalesce(F.lead("n").over(order) == 2, F.lit(False)))
    return i.withColumn("confirmed", ok).select(*PAGE, "block_no", "n", "confirmed")


@query(
    "win_w20_digit_groups",
    f"""WITH {KEYED}, l AS (SELECT doc_id, page, word_no, text, lead(text) OVER (PARTITION BY doc_id, page, line_key ORDER BY word_no) AS after FROM keyed)
      SELECT doc_id, page, word_no, text || after AS joined FROM l WHERE regexp_matches(text, '^\\d{{1,3}}$') AND regexp_matches(after, '^\\d{{3}}([.,]\\d+)?[.,;]?$')""",
)
def win_w20_digit_groups(spark, d):
    """A number split into groups of digits, joined with the group that follows."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("word_no")
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumn("after", F.lead("text").over(line))
    return w.where(F.col("text").rlike(r"^\d{1,3}$") & F.col("after").rlike(r"^\d{3}([.,]\d+)?[.,;]?$")).select(*PAGE, "word_no", F.concat("text", "after").alias("joined"))


@query(
    "win_w21_first_words",
    f"""WITH {KEYED} SELECT doc_id, page, line_key, arg_min(text, (x0, word_no)) AS text FROM keyed GROUP BY ALL""",
)
def win_w21_first_words(spark, d):
    return lay.with_line(table(spark, d, "words").where("text is not null")).groupBy(*PAGE, "line_key").agg(F.min(F.struct("x0", "word_no", "text"))["text"].alias("text"))


@query("win_w22_borderless_grids")
def win_w22_borderless_grids(spark, d):
    """Runs of rows with three or more aligned segments: cells of a page as segments (rows only)."""
    c = table(spark, d, "cells").select(*PAGE, F.col("row_no"), "x0").where("x0 is not null")
    return lay.grid_rows(c)


@query(
    "win_w25_numbering_restarts",
    """WITH i AS (SELECT doc_id, list_id, page, block_no, TRY_CAST(regexp_extract(text, '^\\s*\\(?(\\d{1,3})[.)]', 1) AS INT) AS n FROM blocks WHERE kind = 'list_item'),
      s AS (SELECT *, CASE WHEN lag(n) OVER w IS NULL OR n <> lag(n) OVER w + 1 THEN 1 ELSE 0 END AS restart FROM i WHERE n IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY page, block_no))
      SELECT doc_id, page, block_no, n, sum(restart) OVER (PARTITION BY doc_id ORDER BY page, block_no ROWS UNBOUNDED PRECEDING)::BIGINT AS numbering FROM s""",
)
def win_w25_numbering_restarts(spark, d):
    order = Window.partitionBy("doc_id").orderBy("page", "block_no")
    i = table(spark, d, "blocks").where("kind = 'list_item'").withColumn("n", F.regexp_extract("text", r"^\s*\(?(\d{1,3})[.)]", 1).try_cast("int")).where("n is not null")
    i = i.withColumn("restart", F.when(F.lag("n").over(order).isNull() | (F.col("n") != F.lag("n").over(order) + 1), 1).otherwise(0))
    return i.select("doc_id", "page", "block_no", "n", F.sum("restart").over(order.rowsBetween(Window.unboundedPreceding, 0)).alias("numbering"))


@query("sort_o1_reading_order", "SELECT doc_id, page, block_no, row_number() OVER (PARTITION BY doc_id, page ORDER BY y0, x0, block_no) AS place FROM blocks")
def sort_o1_reading_order(spark, d):
    return table(spark, d, "blocks").select(*PAGE, "block_no", F.row_number().over(Window.partitionBy(*PAGE).orderBy("y0", "x0", "block_no")).alias("place"))


@query(
    "text_f27_list_prefixes",
    """SELECT doc_id, page, block_no, regexp_extract(text, '^\\s*([•●▪*\\-–]|\\(?\\d{1,3}[.)]|[A-Za-z][.)])\\s+', 1) AS marker,
      regexp_matches(text, '^\\s*\\(?\\d|^\\s*[A-Za-z][.)]') AS ordered, list_marker FROM blocks WHERE regexp_matches(text, '^\\s*([•●▪*\\-–]|\\(?\\d{1,3}[.)]|[A-Za-z][.)])\\s+')""",
)
def text_f27_list_prefixes(spark, d):
    b = table(spark, d, "blocks").where(F.col("text").rlike(LIST_PREFIX))
    return b.select(*PAGE, "block_no", F.regexp_extract("text", LIST_PREFIX, 1).alias("marker"), F.col("text").rlike(r"^\s*\(?\d|^\s*[A-Za-z][.)]").alias("ordered"), "list_marker")


@query("text_f3_folded_blocks")
def text_f3_folded_blocks(spark, d):
    """Block texts with their line breaks folded by the separator and hyphen rules (rows only)."""
    b = table(spark, d, "blocks").where(F.col("text").contains("\n"))
    return b.select(*PAGE, "block_no", fold_lines(F.split("text", "\n")).alias("text"))


QUERIES, ORACLES = Q, O
