"""Queries over restoration, labels, alphabets, nearness, top-k and page drawings, with their SQL."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions import geometry as g
from quirefold.functions.text import count_of
from quirefold.operators import layout as lay
from quirefold.operators import raster
from quirefold.operators import restoration as rs
from quirefold.operators import spatial as sp
from quirefold.plans.made import WORDS_TOO, words_too
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


R = lambda x, k=10000: f"floor(({x}) * {k}.0 + 0.5) / {k}.0"
KEYED = "keyed AS (SELECT *, CASE WHEN len(line_id) > 0 THEN array_to_string(line_id, '-') ELSE 'y' || round_even(y0 / 4, 0)::INT END AS line_key FROM words WHERE text IS NOT NULL)"
KEYED_TOO = KEYED.replace("FROM words", "FROM words_too")


@query("text_f10_similarity")
def text_f10_similarity(spark, d):
    """Similarity of a word and its second reading by matching blocks (rows only)."""
    w = table(spark, d, "words").where("alternative <> '' and alternative <> text").select(*PAGE, "word_no", "text", "alternative")
    return rs.similarity(w, "text", "alternative")


@query(
    "text_f15_case_like",
    """SELECT doc_id, page, word_no, CASE WHEN upper(text) = text AND length(regexp_replace(text, '\\P{L}', '', 'g')) > 1 THEN upper(alternative)
      WHEN regexp_matches(text, '^\\p{Lu}') THEN upper(substr(alternative, 1, 1)) || substr(alternative, 2) ELSE alternative END AS moved FROM words WHERE alternative <> '' AND text IS NOT NULL""",
)
def text_f15_case_like(spark, d):
    """Second readings in the case of the word."""
    w = table(spark, d, "words").where("alternative <> '' and text is not null")
    return w.select(*PAGE, "word_no", rs.case_like(F.col("alternative"), F.col("text")).alias("moved"))


@query("text_f18_option_labels")
def text_f18_option_labels(spark, d):
    """Option labels of Cyrillic lists (rows only: few or none in the data; tested on a fixture)."""
    return rs.option_labels(words_too(spark, d))


@query("text_f19_cyrillic_spellings")
def text_f19_cyrillic_spellings(spark, d):
    """Cyrillic spellings of the Uzbek word list (rows only)."""
    return rs.cyrillic_spellings(table(spark, d, "lexicon").where("lang = 'uz' and word is not null"))


@query(
    "text_f21_place_abbreviations",
    f"""WITH {KEYED}, l AS (SELECT doc_id, page, word_no, text, lag(text) OVER (PARTITION BY doc_id, page, line_key ORDER BY word_no) AS before FROM keyed)
      SELECT doc_id, page, word_no, before, text FROM l WHERE regexp_matches(text, '^(қ|sh|г|ş)\\.[,.]?$') AND regexp_matches(before, '^\\p{{Lu}}\\p{{L}}')""",
)
def text_f21_place_abbreviations(spark, d):
    """Abbreviations of a town after a capitalised name."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("word_no")
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumn("before", F.lag("text").over(line))
    return w.where(F.col("text").rlike(r"^(қ|sh|г|ş)\.[,.]?$") & F.col("before").rlike(r"^\p{Lu}\p{L}")).select(*PAGE, "word_no", "before", "text")


@query(
    "text_f26_bullets",
    f"""WITH {WORDS_TOO}, {KEYED_TOO}, l AS (SELECT doc_id, page, word_no, text, x1, y0, y1, row_number() OVER w AS k, lead(x0) OVER w - x1 AS gap FROM keyed WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no))
      SELECT doc_id, page, word_no, text FROM l WHERE k = 1 AND text IN ('e', 'o', 'c', '©', '°', '*', '·') AND gap >= 0.5 * (y1 - y0)""",
)
def text_f26_bullets(spark, d):
    return rs.bullets(words_too(spark, d))


@query(
    "text_f31_numbering_formats",
    """SELECT doc_id, page, block_no, CASE WHEN regexp_matches(list_marker, '^\\(?\\d+[.)]$') THEN 'decimal' WHEN regexp_matches(list_marker, '^[A-Z][.)]$') THEN 'upperLetter' WHEN regexp_matches(list_marker, '^[a-z][.)]$') THEN 'lowerLetter' ELSE 'bullet' END AS format,
      CASE WHEN list_marker LIKE '(%' THEN '(%1)' WHEN list_marker LIKE '%)' THEN '%1)' WHEN list_marker LIKE '%.' THEN '%1.' ELSE '•' END AS level_text FROM blocks WHERE list_marker IS NOT NULL""",
)
def text_f31_numbering_formats(spark, d):
    m = F.col("list_marker")
    form = F.when(m.rlike(r"^\(?\d+[.)]$"), "decimal").when(m.rlike(r"^[A-Z][.)]$"), "upperLetter").when(m.rlike(r"^[a-z][.)]$"), "lowerLetter").otherwise("bullet")
    level = F.when(m.startswith("("), "(%1)").when(m.endswith(")"), "%1)").when(m.endswith("."), "%1.").otherwise("•")
    return table(spark, d, "blocks").where("list_marker is not null").select(*PAGE, "block_no", form.alias("format"), level.alias("level_text"))


@query(
    "script_g10_line_alphabets",
    f"""WITH {KEYED}, s AS (SELECT doc_id, page, line_key, sum(length(regexp_replace(text, '[^\\p{{Cyrillic}}]', '', 'g')))::BIGINT AS c, sum(length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')))::BIGINT AS l FROM keyed GROUP BY ALL)
      SELECT doc_id, page, line_key, CASE WHEN c + l < 3 THEN NULL WHEN c > l THEN 'Cyrillic' ELSE 'Latin' END AS line_script, least(c, l) AS minority FROM s""",
)
def script_g10_line_alphabets(spark, d):
    w = lay.with_line(table(spark, d, "words").where("text is not null"))
    s = w.groupBy(*PAGE, "line_key").agg(F.sum(count_of(F.col("text"), r"\p{IsCyrillic}")).alias("c"), F.sum(count_of(F.col("text"), r"\p{IsLatin}")).alias("l"))
    return s.select(*PAGE, "line_key", F.when(F.col("c") + F.col("l") < 3, None).when(F.col("c") > F.col("l"), "Cyrillic").otherwise("Latin").alias("line_script"), F.least("c", "l").alias("minority"))


@query(
    "lex_l10_foreign_words",
    f"""WITH {KEYED}, s AS (SELECT *, length(regexp_replace(text, '[^\\p{{Cyrillic}}]', '', 'g')) AS c, length(regexp_replace(text, '[^\\p{{Latin}}]', '', 'g')) AS l FROM keyed),
      t AS (SELECT *, sum(c) OVER w AS lc, sum(l) OVER w AS ll FROM s WINDOW w AS (PARTITION BY doc_id, page, line_key))
      SELECT doc_id, page, word_no FROM t WHERE (l BETWEEN 1 AND 2 AND c = 0 AND lc >= 10 AND ll - l < 3) OR (c BETWEEN 1 AND 2 AND l = 0 AND ll >= 10 AND lc - c < 3)""",
)
def lex_l10_foreign_words(spark, d):
    """One or two letters of the other alphabet inside a line of at least ten letters."""
    c, l = count_of(F.col("text"), r"\p{IsCyrillic}"), count_of(F.col("text"), r"\p{IsLatin}")
    line = Window.partitionBy(*PAGE, "line_key")
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumns({"c": c, "l": l})
    w = w.withColumns({"lc": F.sum("c").over(line), "ll": F.sum("l").over(line)})
    return w.where("(l between 1 and 2 and c = 0 and lc >= 10 and ll - l < 3) or (c between 1 and 2 and l = 0 and ll >= 10 and lc - c < 3)").select(*PAGE, "word_no")


@query("lex_l11_restored")
def lex_l11_restored(spark, d):
    """Unknown words with their best restoration (rows only: ranked by an edit distance in characters)."""
    return rs.restored(table(spark, d, "words"), table(spark, d, "lexicon"))


@query(
    "lex_l13_number_votes",
    """SELECT doc_id, page, word_no, regexp_replace(text, '[^\\p{Nd}]', '', 'g') AS first, regexp_replace(alternative, '[^\\p{Nd}]', '', 'g') AS second,
      CASE WHEN regexp_replace(text, '[^\\p{Nd}]', '', 'g') = regexp_replace(alternative, '[^\\p{Nd}]', '', 'g') THEN 'confirmed' WHEN alternative = '' THEN 'unseen' ELSE 'disputed' END AS vote
      FROM words WHERE alternative IS NOT NULL AND regexp_matches(text, '\\p{Nd}')""",
)
def lex_l13_number_votes(spark, d):
    """Numbers confirmed, disputed or not seen by the second reading."""
    n = lambda c: F.regexp_replace(c, r"[^\p{Nd}]", "")
    a, b = n("text"), n("alternative")
    w = table(spark, d, "words").where(F.col("alternative").isNotNull() & F.col("text").rlike(r"\p{Nd}"))
    return w.select(*PAGE, "word_no", a.alias("first"), b.alias("second"), F.when(a == b, "confirmed").when(F.col("alternative") == "", "unseen").otherwise("disputed").alias("vote"))


@query(
    "lex_l14_initials",
    "SELECT doc_id, page, word_no, regexp_extract(text, '^\\P{L}*(\\p{Lu})\\.', 1) AS initial, alternative IS NOT NULL AND regexp_extract(alternative, '^\\P{L}*(\\p{Lu})\\.', 1) = regexp_extract(text, '^\\P{L}*(\\p{Lu})\\.', 1) AS confirmed FROM words WHERE regexp_matches(text, '^\\P{L}*\\p{Lu}\\.')",
)
def lex_l14_initials(spark, d):
    i = lambda c: F.regexp_extract(c, r"^\P{L}*(\p{Lu})\.", 1)
    w = table(spark, d, "words").where(F.col("text").rlike(r"^\P{L}*\p{Lu}\."))
    return w.select(*PAGE, "word_no", i("text").alias("initial"), (F.col("alternative").isNotNull() & (i(F.coalesce("alternative", F.lit(""))) == i("text"))).alias("confirmed"))


_WEAK_FIELD = "source_region = 'ocr_unstable'"


@query(
    "join_j8_doubtful_near_fields",
    f"""SELECT doc_id, page, word_no FROM words w WHERE NOT ({_WEAK_FIELD}) AND confidence < 0.9 AND NOT coalesce(alternative = text, false) AND regexp_matches(text, '[\\p{{L}}\\p{{N}}]') AND EXISTS
      (SELECT 1 FROM words m WHERE m.source_region = 'ocr_unstable' AND m.doc_id = w.doc_id AND m.page = w.page
      AND greatest(0, greatest(m.y0 - w.y1, w.y0 - m.y1)) <= greatest(w.y1 - w.y0, m.y1 - m.y0) AND greatest(0, greatest(m.x0 - w.x1, w.x0 - m.x1)) <= 3 * greatest(w.y1 - w.y0, m.y1 - m.y0))""",
)
def join_j8_doubtful_near_fields(spark, d):
    """Words that two readings do not agree on, weaker than .9, within one height above or below and three heights beside a
    field. The tables mark no empty fields; unstable readings stand where handwriting was."""
    words = table(spark, d, "words")
    agreed = F.coalesce(F.col("alternative") == F.col("text"), F.lit(False))
    w = words.where((F.col("source_region") != "ocr_unstable") & (F.col("confidence") < 0.9) & ~F.isnan("confidence") & ~agreed & F.col("text").rlike(r"[\p{L}\p{N}]"))
    m = words.where(_WEAK_FIELD).select(*[F.col(c).alias(f"m_{c}") for c in (*PAGE, "x0", "y0", "x1", "y1")])
    h = F.greatest(g.height(), g.height("m_"))
    near = (-g.y_overlap("", "m_") <= h) & (-g.x_overlap("", "m_") <= 3 * h)
    w = w.select(*PAGE, "word_no", "x0", "y0", "x1", "y1")
    return w.join(m, (F.col("doc_id") == F.col("m_doc_id")) & (F.col("page") == F.col("m_page")) & near, "left_semi").select(*PAGE, "word_no")


@query(
    "join_j18_single_slots",
    """WITH e AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM cells),
      n AS (SELECT *, CASE WHEN edge IS NULL OR x0 > edge + 4.0 THEN 1 ELSE 0 END AS new FROM e), s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, y0, y1 ROWS UNBOUNDED PRECEDING) AS slot_no FROM n),
      t AS (SELECT doc_id, page, slot_no, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY ALL)
      SELECT b.doc_id, b.page, b.block_no, count(*) AS n_slots FROM blocks b JOIN t ON b.doc_id = t.doc_id AND b.page = t.page AND least(b.x1, t.x1) - greatest(b.x0, t.x0) > 0 GROUP BY ALL""",
)
def join_j18_single_slots(spark, d):
    """How many column slots of its page a block overlaps (it fits one where that is 1)."""
    s = sp.prefixed(lay.slots(table(spark, d, "cells")).select(*PAGE, "slot_no", "x0", "x1"), "s_")
    b = table(spark, d, "blocks").join(s, PAGE).where(g.x_overlap("", "s_") > 0)
    return b.groupBy(*PAGE, "block_no").agg(F.count("*").alias("n_slots"))


@query(
    "join_j19_halves",
    f"""WITH {WORDS_TOO}, {KEYED_TOO}, l AS (SELECT doc_id, page, word_no, text, alternative, lead(text) OVER w AS after, lead(word_no) OVER w AS after_no FROM keyed WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no))
      SELECT doc_id, page, word_no, after_no, alternative AS joined FROM l WHERE alternative <> '' AND text || after = alternative""",
)
def join_j19_halves(spark, d):
    return rs.halves(words_too(spark, d))


@query("join_j20_components")
def join_j20_components(spark, d):
    """Table cells joined into groups by nearness: labels spread inside pages until none changes (rows only)."""
    c = table(spark, d, "cells").select(*PAGE, (F.col("table_no") * 1000000 + F.col("row_no") * 1000 + F.col("col_no")).cast("long").alias("id"), "x0", "y0", "x1", "y1")
    return rs.merged_boxes(c).groupBy(*PAGE, "label").agg(F.count("*").alias("n"))


@query(
    "sort_o6_weak_words",
    "SELECT doc_id, string_agg(page || ':' || word_no, ' ' ORDER BY confidence, page, word_no) AS places FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY confidence, page, word_no) AS k FROM words WHERE confidence < 0.8) WHERE k <= 20 GROUP BY doc_id",
)
def sort_o6_weak_words(spark, d):
    """The twenty weakest words of each document."""
    w = table(spark, d, "words").where("confidence < 0.8 and not isnan(confidence)")
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("confidence", "page", "word_no"))
    top = w.withColumn("k", k).where("k <= 20").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("k", "page", "word_no"))).alias("s"))
    return top.select("doc_id", F.array_join(F.transform("s", lambda x: F.concat_ws(":", x["page"], x["word_no"])), " ").alias("places"))


@query(
    "win_w16_error_runs",
    f"""WITH {KEYED}, f AS (SELECT *, coalesce(confidence < 0.8, false) AS weak FROM keyed),
      s AS (SELECT *, sum(CASE WHEN weak AND NOT coalesce(was, false) OR NOT weak THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no ROWS UNBOUNDED PRECEDING) AS run_no
        FROM (SELECT *, lag(weak) OVER (PARTITION BY doc_id, page, line_key ORDER BY x0, word_no) AS was FROM f)),
      r AS (SELECT doc_id, page, line_key, run_no, bool_and(weak) AS weak, count(*) AS n_words, min(x0) AS a, max(x1) AS b, max(y1 - y0) * 2.5 AS reach FROM s GROUP BY ALL),
      n AS (SELECT *, a - lag(b) OVER w AS before, lead(a) OVER w - b AS after FROM r WINDOW w AS (PARTITION BY doc_id, page, line_key ORDER BY run_no))
      SELECT doc_id, page, line_key, run_no::BIGINT AS run_no, n_words, coalesce(before, 1e9) > reach AND coalesce(after, 1e9) > reach AS isolated FROM n WHERE weak""",
)
def win_w16_error_runs(spark, d):
    """Runs of weak words of a line, and whether both gaps beside a run exceed two and a half of its heights."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    w = lay.with_line(table(spark, d, "words").where("text is not null")).withColumn("weak", F.coalesce(F.col("confidence") < 0.8, F.lit(False)) & ~F.isnan(F.coalesce("confidence", F.lit(0.0))))
    starts = F.when(~F.col("weak") | ~F.coalesce(F.lag("weak").over(line), F.lit(False)), 1).otherwise(0)
    runs = w.withColumn("new", starts).withColumn("run_no", F.sum("new").over(line.rowsBetween(Window.unboundedPreceding, 0)))
    r = runs.groupBy(*PAGE, "line_key", "run_no").agg(F.every("weak").alias("weak"), F.count("*").alias("n_words"), F.min("x0").alias("a"), F.max("x1").alias("b"), (F.max(g.height()) * 2.5).alias("reach"))
    beside = Window.partitionBy(*PAGE, "line_key").orderBy("run_no")
    far = lambda c: F.coalesce(c, F.lit(1e9)) > F.col("reach")
    r = r.withColumns({"before": F.col("a") - F.lag("b").over(beside), "after": F.lead("a").over(beside) - F.col("b")})
    return r.where("weak").select(*PAGE, "line_key", "run_no", "n_words", (far(F.col("before")) & far(F.col("after"))).alias("isolated"))


@query(
    "quality_m1_margins",
    f"""SELECT doc_id, page, least(100.0, greatest(42.0, min(x0))) AS left_margin, {R("least(100.0, greatest(42.0, 595.0 - max(x1)))")} AS right_margin, round_even(max(size) * 2, 0) / 2 AS largest FROM blocks WHERE size IS NOT NULL GROUP BY ALL""",
)
def quality_m1_margins(spark, d):
    clamp = lambda c: F.least(F.lit(100.0), F.greatest(F.lit(42.0), c))
    b = table(spark, d, "blocks").where("size is not null")
    return b.groupBy(*PAGE).agg(clamp(F.min("x0")).alias("left_margin"), g.rounded(clamp(595.0 - F.max("x1"))).alias("right_margin"), (F.bround(F.max("size") * 2) / 2).alias("largest"))


@query("raster_i_page_drawings")
def raster_i_page_drawings(spark, d):
    """Words of scanned pages drawn as ink at a third of a point, and what the array operators measure on
    them (rows only; the operators are tested on small arrays)."""
    w = table(spark, d, "words").where(F.col("source_region").startswith("ocr"))

    def draw(rows: list[tuple]) -> list[tuple]:
        gray = np.full((300, 210), 255, dtype=np.uint8)
        spots = []
        for _, _, y0, x0, x1, y1 in rows:
            a, b, c, e = int(x0 / 3), int(y0 / 3), max(int(x0 / 3) + 1, int(x1 / 3)), max(int(y0 / 3) + 1, int(y1 / 3) - 1)
            gray[b:e, a:c] = 0
            spots.append((a, b, c, e))
        t = raster.otsu(gray)
        ink = gray <= t
        return [(rows[0][0], rows[0][1], len(rows), int(raster.components(ink).max()), len(raster.gutters(ink)), raster.skew(ink), raster.covered_share(ink, spots))]

    schema = "doc_id bigint, page int, n_words int, components int, gutters int, skew double, covered double"
    return lay.by_page(w.select(*PAGE, "y0", "x0", "x1", "y1"), ["y0", "x0"], draw, schema)


QUERIES, ORACLES = Q, O
