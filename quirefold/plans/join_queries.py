"""Queries over joins of words, blocks, cells, runs, readings, journal and word list, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F


from quirefold.functions import geometry as g
from quirefold.functions.text import vote_form
from quirefold.operators import layout as lay
from quirefold.operators import spatial as sp
from quirefold.operators.once import canonical_path
from quirefold.plans.made import BLOCKS_TOO, PLAN_TOO, WORDS_TOO, blocks_too, plan_too, words_too
from quirefold.session import table

PAGE = sp.PAGE
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
IN = lambda o, i: f"({i}.x0 + {i}.x1) / 2 BETWEEN {o}.x0 AND {o}.x1 AND ({i}.y0 + {i}.y1) / 2 BETWEEN {o}.y0 AND {o}.y1"
XO = lambda a, b: f"(least({a}.x1, {b}.x1) - greatest({a}.x0, {b}.x0))"
YO = lambda a, b: f"(least({a}.y1, {b}.y1) - greatest({a}.y0, {b}.y0))"


@query(
    "join_j1_span_styles",
    f"""SELECT w.doc_id, w.page, w.word_no, arg_min(r.bold, (r.block_no, r.run_no)) AS bold, arg_min(r.italic, (r.block_no, r.run_no)) AS italic, arg_min(r.size, (r.block_no, r.run_no)) AS size
      FROM words w JOIN runs r ON w.doc_id = r.doc_id AND w.page = r.page AND {IN("r", "w")} GROUP BY ALL""",
)
def join_j1_span_styles(spark, d):
    """The style of the first run that holds a word's centre."""
    runs = table(spark, d, "runs").select(*PAGE, "block_no", "run_no", "bold", "italic", "size", "x0", "y0", "x1", "y1")
    words = table(spark, d, "words").select(*PAGE, "word_no", "x0", "y0", "x1", "y1")
    return sp.first_style(words, runs, F.struct("b_block_no", "b_run_no")).select(*PAGE, "word_no", "s.bold", "s.italic", "s.size")


@query(
    "join_j2_block_words",
    f"""SELECT b.doc_id, b.page, b.block_no, count(*) AS n_words, string_agg(w.text, ' ' ORDER BY w.y0, w.x0, w.word_no) AS text
      FROM words w JOIN blocks b ON w.doc_id = b.doc_id AND w.page = b.page AND {IN("b", "w")} WHERE w.text IS NOT NULL GROUP BY ALL""",
)
def join_j2_block_words(spark, d):
    """The words whose centre a block holds, in reading order."""
    b = table(spark, d, "blocks").select(*PAGE, "block_no", "x0", "y0", "x1", "y1")
    w = table(spark, d, "words").where("text is not null").select(*PAGE, "word_no", "text", "x0", "y0", "x1", "y1")
    s = sp.inside(w, b).groupBy(*PAGE, F.col("b_block_no").alias("block_no")).agg(F.count("*").alias("n_words"), F.sort_array(F.collect_list(F.struct("y0", "x0", "word_no", "text"))).alias("s"))
    return s.select(*PAGE, "block_no", "n_words", F.array_join(F.transform("s", lambda x: x["text"]), " ").alias("text"))


@query(
    "join_j3_words_outside",
    f"WITH {WORDS_TOO} SELECT doc_id, page, word_no FROM words_too w WHERE NOT EXISTS (SELECT 1 FROM cells b WHERE b.doc_id = w.doc_id AND b.page = w.page AND {IN('b', 'w')}) AND NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = w.doc_id AND b.page = w.page AND {IN('b', 'w')})",
)
def join_j3_words_outside(spark, d):
    """Words that neither a table cell nor a block holds."""
    w = words_too(spark, d).select(*PAGE, "word_no", "x0", "y0", "x1", "y1")
    return sp.outside(sp.outside(w, table(spark, d, "cells")), table(spark, d, "blocks")).select(*PAGE, "word_no")


_VOTE = lambda x: f"regexp_replace(replace(translate(translate({x}, '’‘ʼ`''—–‐‑', 'ʻʻʻʻʻ----'), 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху'), ' ', ''), '^[|\\[\\]{{}}_]+|[|\\[\\]{{}}_]+$', '', 'g')"


@query(
    "join_j4_second_readings",
    f"""WITH j AS (SELECT w.doc_id, w.page, w.word_no, w.text, string_agg(o.text, '' ORDER BY o.x0, o.word_no) AS second FROM words w JOIN words o ON w.doc_id = o.doc_id AND w.page = o.page
        AND (o.x0 + o.x1) / 2 BETWEEN w.x0 - 0.15 * (w.y1 - w.y0) AND w.x1 + 0.15 * (w.y1 - w.y0) AND {YO("w", "o")} > 0.5 * least(w.y1 - w.y0, o.y1 - o.y0)
        WHERE w.text IS NOT NULL AND o.text IS NOT NULL AND w.word_no <> o.word_no GROUP BY ALL)
      SELECT doc_id, page, word_no, second, {_VOTE("text")} = {_VOTE("second")} AS agrees FROM j""",
)
def join_j4_second_readings(spark, d):
    """Words with what another reading of the page has in their place (pages whose words occur twice)."""
    w = table(spark, d, "words").where("text is not null")
    o = sp.prefixed(w.select(*PAGE, "word_no", "text", "x0", "y0", "x1", "y1"), "o_")
    slack = 0.15 * g.height()
    hit = g.centre_x("o_").between(F.col("x0") - slack, F.col("x1") + slack) & (g.y_overlap("", "o_") > 0.5 * F.least(g.height(), g.height("o_")))
    j = w.select(*PAGE, "word_no", "text", "x0", "y0", "x1", "y1").join(o, PAGE).where(hit & (F.col("word_no") != F.col("o_word_no")))
    j = j.groupBy(*PAGE, "word_no", "text").agg(F.sort_array(F.collect_list(F.struct("o_x0", "o_word_no", "o_text"))).alias("s"))
    j = j.withColumn("second", F.array_join(F.transform("s", lambda x: x["o_text"]), ""))
    return j.select(*PAGE, "word_no", "second", (vote_form(F.col("text")) == vote_form(F.col("second"))).alias("agrees"))


@query(
    "join_j5_without_repeats",
    f"SELECT doc_id, page, word_no FROM words w WHERE NOT EXISTS (SELECT 1 FROM words e WHERE e.doc_id = w.doc_id AND e.page = w.page AND e.word_no < w.word_no AND (({IN('e', 'w')}) OR ({IN('w', 'e')})))",
)
def join_j5_without_repeats(spark, d):
    """Words that coincide with no earlier word of their page."""
    return sp.without_repeats(table(spark, d, "words").select(*PAGE, "word_no", "x0", "y0", "x1", "y1")).select(*PAGE, "word_no")


@query(
    "join_j7_near_weak",
    f"""SELECT doc_id, page, word_no FROM words w WHERE w.confidence < 0.8 AND EXISTS (SELECT 1 FROM words f WHERE f.confidence < 0.72 AND f.doc_id = w.doc_id AND f.page = w.page AND f.word_no <> w.word_no
      AND {YO("w", "f")} > 0.3 * least(w.y1 - w.y0, f.y1 - f.y0) AND -{XO("w", "f")} <= 2.0 * (w.y1 - w.y0))""",
)
def join_j7_near_weak(spark, d):
    """Weak words beside a very weak one (an empty field's neighbourhood)."""
    w = table(spark, d, "words").select(*PAGE, "word_no", "confidence", "x0", "y0", "x1", "y1").where("confidence < 0.8")
    f = table(spark, d, "words").where("confidence < 0.72").select(*[F.col(c).alias(f"f_{c}") for c in (*PAGE, "word_no", "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("f_doc_id")) & (F.col("page") == F.col("f_page")) & (F.col("word_no") != F.col("f_word_no"))
    beside = (g.y_overlap("", "f_") > 0.3 * F.least(g.height(), g.height("f_"))) & (-g.x_overlap("", "f_") <= 2.0 * g.height())
    return w.join(f, same & beside, "left_semi").select(*PAGE, "word_no")


@query(
    "join_j9_crossed_words",
    f"WITH {WORDS_TOO}, {BLOCKS_TOO} SELECT doc_id, page, word_no FROM words_too w WHERE EXISTS (SELECT 1 FROM blocks_too m WHERE m.block_type = 'graphic' AND m.doc_id = w.doc_id AND m.page = w.page AND {YO('w', 'm')} > 0 AND {XO('w', 'm')} > 0)",
)
def join_j9_crossed_words(spark, d):
    """Words that a graphic block overlaps."""
    w = words_too(spark, d).select(*PAGE, "word_no", "x0", "y0", "x1", "y1")
    return sp.crossed(w, blocks_too(spark, d).where("block_type = 'graphic'")).select(*PAGE, "word_no")


@query(
    "join_j10_letterheads",
    f"""WITH top AS (SELECT doc_id, page, min(y0) + 0.25 * (max(y1) - min(y0)) AS edge FROM words GROUP BY ALL)
      SELECT w.doc_id, w.page, w.word_no FROM words w JOIN top t ON w.doc_id = t.doc_id AND w.page = t.page WHERE w.y1 <= t.edge AND EXISTS
      (SELECT 1 FROM words b WHERE b.bold AND b.doc_id = w.doc_id AND b.page = w.page AND b.word_no <> w.word_no AND {YO("w", "b")} > 0 AND -{XO("w", "b")} <= 3.0 * (w.y1 - w.y0))""",
)
def join_j10_letterheads(spark, d):
    """Words in the top quarter of the text beside a bold word."""
    words = table(spark, d, "words").select(*PAGE, "word_no", "bold", "x0", "y0", "x1", "y1")
    top = words.groupBy(*PAGE).agg((F.min("y0") + 0.25 * (F.max("y1") - F.min("y0"))).alias("edge"))
    b = words.where("bold").select(*[F.col(c).alias(f"b_{c}") for c in (*PAGE, "word_no", "x0", "y0", "x1", "y1")])
    same = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page") == F.col("b_page")) & (F.col("word_no") != F.col("b_word_no"))
    w = words.join(top, PAGE).where("y1 <= edge")
    return w.join(b, same & (g.y_overlap("", "b_") > 0) & (-g.x_overlap("", "b_") <= 3.0 * g.height()), "left_semi").select(*PAGE, "word_no")


_TOK = "regexp_replace(lower(replace(text, 'İ', 'i')), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"


@query(
    "join_j11_token_languages",
    f"""WITH t AS (SELECT {_TOK} AS token, count(*) AS n FROM words WHERE text IS NOT NULL GROUP BY 1), l AS (SELECT DISTINCT lang, word FROM lexicon)
      SELECT token, n, count(lang) AS n_langs, string_agg(lang, '+' ORDER BY lang) AS langs FROM t LEFT JOIN l ON t.token = l.word WHERE length(token) > 1 GROUP BY token, n""",
)
def join_j11_token_languages(spark, d):
    """The languages whose word list holds a token; tokens are distinct before the join."""
    tok = F.regexp_replace(F.lower(F.replace("text", F.lit("İ"), F.lit("i"))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    t = table(spark, d, "words").where("text is not null").groupBy(tok.alias("token")).agg(F.count("*").alias("n")).where("length(token) > 1")
    l = table(spark, d, "lexicon").groupBy("word").agg(F.sort_array(F.collect_set("lang")).alias("l"))
    return t.join(l, t.token == l.word, "left").select("token", "n", F.coalesce(F.size("l"), F.lit(0)).cast("long").alias("n_langs"), F.array_join("l", "+").alias("langs"))


@query(
    "join_j12_repeated_lines",
    f"""WITH {WORDS_TOO}, k AS (SELECT *, array_to_string(line_id, '-') AS line_key FROM words_too WHERE text IS NOT NULL),
      l AS (SELECT doc_id, page, line_key, min(word_no) AS first_no, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, avg(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END) AS c FROM k GROUP BY ALL)
      SELECT a.doc_id, a.page, a.line_key FROM l a WHERE EXISTS (SELECT 1 FROM l b WHERE a.doc_id = b.doc_id AND a.page = b.page AND a.line_key <> b.line_key AND {IN("b", "a")} AND (b.c > a.c OR (b.c = a.c AND b.first_no < a.first_no)))""",
)
def join_j12_repeated_lines(spark, d):
    """Lines whose centre lies in a better read line of the page."""
    k = words_too(spark, d).where("text is not null").withColumn("line_key", F.array_join(F.col("line_id").cast("array<string>"), "-"))
    l = k.groupBy(*PAGE, "line_key").agg(F.min("word_no").alias("first_no"), *g.enclosing(), F.avg(F.nanvl("confidence", F.lit(0.0))).alias("c"))
    b = l.select(*[F.col(c).alias(f"b_{c}") for c in l.columns])
    same = (F.col("doc_id") == F.col("b_doc_id")) & (F.col("page") == F.col("b_page")) & (F.col("line_key") != F.col("b_line_key"))
    better = (F.col("b_c") > F.col("c")) | ((F.col("b_c") == F.col("c")) & (F.col("b_first_no") < F.col("first_no")))
    return l.join(b, same & g.contains_centre("b_") & better, "left_semi").select(*PAGE, "line_key")


@query(
    "join_j14_todo_files",
    r"""WITH n AS (SELECT regexp_replace(regexp_replace(regexp_replace(trim(file), '\\+', '/', 'g'), '/(\./|/)+', '/', 'g'), '^(\./+)+', '') AS name, outcome FROM journal WHERE file IS NOT NULL)
      SELECT name, count(*) AS n FROM n GROUP BY name HAVING count(*) FILTER (outcome IN ('issued', 'refused')) = 0
      UNION ALL SELECT 'new/' || name, 0 FROM (SELECT DISTINCT name FROM n WHERE outcome = 'refused') WHERE name LIKE '%7.pdf'""",
)
def join_j14_todo_files(spark, d):
    """Documents without a result: of a folder that holds the journal's files and some new ones, those that
    the journal neither issued nor refused, under one spelling of the path. The hot file collapses in the aggregation."""
    j = table(spark, d, "journal").where("file is not null").select(canonical_path(F.col("file")).alias("name"), "outcome")
    done = j.where(F.col("outcome").isin("issued", "refused")).select("name").distinct()
    new = j.where((F.col("outcome") == "refused") & F.col("name").endswith("7.pdf")).select(F.concat(F.lit("new/"), "name").alias("name")).distinct().withColumn("n", F.lit(0).cast("long"))
    folder = j.groupBy("name").agg(F.count("*").alias("n")).unionByName(new)
    return folder.join(done, "name", "left_anti")


@query(
    "join_j16_token_multisets",
    """WITH r AS (SELECT doc_id, page, block_no, string_agg(text, '' ORDER BY run_no) AS text FROM runs GROUP BY ALL),
      a AS (SELECT doc_id, page, block_no, unnest(string_split(text, ' ')) AS token FROM blocks WHERE text IS NOT NULL),
      b AS (SELECT doc_id, page, block_no, unnest(string_split(text, ' ')) AS token FROM r WHERE text IS NOT NULL)
      SELECT 'block' AS side, count(*) AS n FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT 'runs', count(*) FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)""",
)
def join_j16_token_multisets(spark, d):
    """Tokens of blocks that their runs lack and the other way round, as multisets."""
    cols = [*PAGE, "block_no"]
    r = table(spark, d, "runs").groupBy(*cols).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda s: s["text"]), "").alias("text"))
    tok = lambda t: t.where("text is not null").select(*cols, F.explode(F.split("text", " ")).alias("token"))
    a, b = tok(table(spark, d, "blocks")), tok(r)
    side = lambda x, y, n: x.exceptAll(y).agg(F.count("*").alias("n")).select(F.lit(n).alias("side"), "n")
    return side(a, b, "block").unionByName(side(b, a, "runs"))


@query(
    "join_j17_slot_columns",
    """WITH e AS (SELECT *, max(x1) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, y0, y1 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS edge FROM cells),
      n AS (SELECT *, CASE WHEN edge IS NULL OR x0 > edge + 4.0 THEN 1 ELSE 0 END AS new FROM e),
      s AS (SELECT *, sum(new) OVER (PARTITION BY doc_id, page ORDER BY x0, x1, y0, y1 ROWS UNBOUNDED PRECEDING) AS slot_no FROM n),
      t AS (SELECT doc_id, page, slot_no, min(x0) AS x0, max(x1) AS x1 FROM s GROUP BY ALL)
      SELECT c.doc_id, c.page, t.slot_no::BIGINT AS slot_no, count(*) AS n_cells, count(DISTINCT c.col_no) AS n_columns FROM cells c JOIN t ON c.doc_id = t.doc_id AND c.page = t.page
      AND (c.x0 + c.x1) / 2 BETWEEN t.x0 - 1.0 AND t.x1 + 1.0 GROUP BY c.doc_id, c.page, t.slot_no""",
)
def join_j17_slot_columns(spark, d):
    c = table(spark, d, "cells")
    return sp.in_slots(c, lay.slots(c)).groupBy(*PAGE, F.col("s_slot_no").alias("slot_no")).agg(F.count("*").alias("n_cells"), F.count_distinct("col_no").alias("n_columns"))


@query(
    "join_j22_orphans",
    f"""WITH {WORDS_TOO} SELECT 'run without block' AS issue, doc_id, page, block_no AS item FROM runs r WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = r.doc_id AND b.page = r.page AND b.block_no = r.block_no)
      UNION ALL SELECT 'cell without table', doc_id, page, table_no FROM cells c WHERE NOT EXISTS (SELECT 1 FROM blocks b WHERE b.doc_id = c.doc_id AND b.page = c.page AND b.block_type = 'table')
      UNION ALL SELECT 'word without plan', doc_id, page, word_no FROM words_too w WHERE NOT EXISTS (SELECT 1 FROM page_plan p WHERE p.doc_id = w.doc_id AND p.page = w.page)""",
)
def join_j22_orphans(spark, d):
    """Rows whose parent is missing."""
    b, p = table(spark, d, "blocks"), table(spark, d, "page_plan")
    runs = table(spark, d, "runs").join(b.select(*PAGE, "block_no"), [*PAGE, "block_no"], "left_anti").select(F.lit("run without block").alias("issue"), *PAGE, F.col("block_no").alias("item"))
    cells = table(spark, d, "cells").join(b.where("block_type = 'table'").select(*PAGE), PAGE, "left_anti").select(F.lit("cell without table").alias("issue"), *PAGE, F.col("table_no").alias("item"))
    words = words_too(spark, d).join(p.select(*PAGE), PAGE, "left_anti").select(F.lit("word without plan").alias("issue"), *PAGE, F.col("word_no").alias("item"))
    return runs.unionByName(cells).unionByName(words)


@query(
    "set_u1_word_union",
    "SELECT lower(word) AS word FROM lexicon WHERE word IS NOT NULL UNION SELECT regexp_replace(lower(text), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') FROM words WHERE confidence >= 0.95 AND text IS NOT NULL",
)
def set_u1_word_union(spark, d):
    """The word list and well read words, each once."""
    tok = F.regexp_replace(F.lower("text"), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")
    read = table(spark, d, "words").where("text is not null and confidence >= 0.95 and not isnan(confidence)").select(tok.alias("word"))
    nan = table(spark, d, "words").where("text is not null and isnan(confidence)").select(tok.alias("word"))  # NaN counts as greatest in SQL
    return table(spark, d, "lexicon").where("word is not null").select(F.lower("word").alias("word")).unionByName(read).unionByName(nan).distinct()


@query("set_u2_common_languages", "SELECT DISTINCT lang FROM documents WHERE lang IS NOT NULL INTERSECT SELECT lang FROM lexicon")
def set_u2_common_languages(spark, d):
    return table(spark, d, "documents").where("lang is not null").select("lang").intersect(table(spark, d, "lexicon").select("lang"))


@query(
    "set_u3_missing_pages",
    f"WITH {WORDS_TOO}, {PLAN_TOO} SELECT doc_id, page FROM plan_too WHERE route <> 'BLANK' AND doc_id IN (SELECT doc_id FROM words_too) EXCEPT SELECT doc_id, page FROM words_too",
)
def set_u3_missing_pages(spark, d):
    """Planned pages of documents with words that have none themselves."""
    w = words_too(spark, d).select(*PAGE)
    planned = plan_too(spark, d).where("route <> 'BLANK'").join(w.select("doc_id").distinct(), "doc_id", "left_semi").select(*PAGE)
    return planned.distinct().join(w.distinct(), PAGE, "left_anti")


@query("set_u4_repeated_plans", "SELECT doc_id, page, count(*) AS n FROM page_plan GROUP BY ALL HAVING count(*) > 1")
def set_u4_repeated_plans(spark, d):
    return table(spark, d, "page_plan").groupBy(*PAGE).agg(F.count("*").alias("n")).where("n > 1")


@query(
    "agg_g24_bag_difference",
    """WITH a AS (SELECT doc_id, page, text AS token, count(*) AS n FROM words WHERE text IS NOT NULL GROUP BY ALL),
      b AS (SELECT doc_id, page, unnest(regexp_split_to_array(text, '\\s+')) AS token FROM blocks WHERE text IS NOT NULL),
      c AS (SELECT doc_id, page, token, count(*) AS n FROM b WHERE token <> '' GROUP BY ALL)
      SELECT doc_id, page, sum(abs(coalesce(a.n, 0) - coalesce(c.n, 0)))::BIGINT AS difference FROM a FULL JOIN c USING (doc_id, page, token) GROUP BY doc_id, page""",
)
def agg_g24_bag_difference(spark, d):
    """Symmetric multiset difference of a page's words and its blocks' tokens."""
    a = table(spark, d, "words").where("text is not null").groupBy(*PAGE, F.col("text").alias("token")).agg(F.count("*").alias("n"))
    c = table(spark, d, "blocks").where("text is not null").select(*PAGE, F.explode(F.split("text", r"\s+")).alias("token")).where("token <> ''").groupBy(*PAGE, "token").agg(F.count("*").alias("m"))
    return a.join(c, [*PAGE, "token"], "full").groupBy(*PAGE).agg(F.sum(F.abs(F.coalesce("n", F.lit(0)) - F.coalesce("m", F.lit(0)))).alias("difference"))


@query("set_u7_readings_union", "SELECT doc_id, page, 'first' AS reading, count(*) AS n FROM words GROUP BY ALL UNION ALL SELECT doc_id, page, 'second', count(*) FROM words WHERE alternative IS NOT NULL GROUP BY ALL")
def set_u7_readings_union(spark, d):
    w = table(spark, d, "words")
    one = w.groupBy(*PAGE).agg(F.count("*").alias("n")).withColumn("reading", F.lit("first"))
    return one.unionByName(w.where("alternative is not null").groupBy(*PAGE).agg(F.count("*").alias("n")).withColumn("reading", F.lit("second")))



QUERIES, ORACLES = Q, O
