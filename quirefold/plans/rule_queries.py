"""Queries over rules of single pages, words and runs: verdicts, normalisation, gates, dropped lines, fonts,
capabilities, statuses, overlaps with pictures and columns, with their SQL. Inputs that the tables lack are
literal rows, the same on both sides."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.functions import geometry as g
from quirefold.functions import text as tx
from quirefold.operators import lexical as lex
from quirefold.operators import rules as ru
from quirefold.plans.made import PLAN_TOO, WORDS_TOO, plan_too, words_too
from quirefold.plans.text_queries import LIST, NATIONAL, TOK, R, edit_distance
from quirefold.session import table

PAGE = ["doc_id", "page"]
Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


def literal(spark: SparkSession, schema: str, rows: list[tuple]) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def values(schema: str, rows: list[tuple]) -> str:
    """The same rows as a SQL table expression."""

    def put(v) -> str:
        return "NULL" if v is None else str(v).upper() if isinstance(v, bool) else str(v) if isinstance(v, (int, float)) else "'" + str(v).replace("'", "''") + "'"

    names = ", ".join(c.split()[0] for c in schema.split(", "))
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(put, r)) + ')' for r in rows)}) AS v({names}))"


# ---------------------------------------------------------------- fonts, variants, capabilities, statuses

_HINTS = [(1, "GlyphLessFont"), (2, "Tesseract-Sans"), (3, "OCRB"), (4, "Noto Sans"), (5, None), (6, ""), (7, "AB+ocrb10")]


@query("pred_p17_ocr_fonts", f"SELECT span_id, coalesce(regexp_matches(lower(font), 'glyphless|tesseract|ocrb'), false) AS ocr_font FROM {values('span_id, font', _HINTS)}")
def pred_p17_ocr_fonts(spark, d):
    """Spans whose font name shows a text layer written by OCR; null and empty names show none."""
    return literal(spark, "span_id int, font string", _HINTS).select("span_id", F.coalesce(F.lower("font").rlike("glyphless|tesseract|ocrb"), F.lit(False)).alias("ocr_font"))


_T, _S = ru.TRADITIONAL, ru.SIMPLIFIED


@query(
    "text_f24_han_variants",
    f"SELECT doc_id, page, block_no, run_no, CASE WHEN regexp_matches(text, '[{_T}]') THEN CASE WHEN regexp_matches(text, '[{_S}]') THEN 'none' ELSE 'TC' END WHEN regexp_matches(text, '[{_S}]') THEN 'SC' ELSE 'none' END AS variant FROM runs WHERE regexp_matches(text, '\\p{{Han}}')",
)
def text_f24_han_variants(spark, d):
    """The variant of Han runs by characters that only one of the two has; none where both or neither occur."""
    r = table(spark, d, "runs").where(F.col("text").rlike(r"\p{IsHan}"))
    return r.select(*PAGE, "block_no", "run_no", F.coalesce(ru.han_variant(F.col("text")), F.lit("none")).alias("variant"))


_FONTS = "CASE WHEN script = 'Han' OR regexp_matches(text, '[㐀-鿿]') THEN CASE WHEN regexp_matches(text, '[{t}]') AND NOT regexp_matches(text, '[{s}]') THEN 'Noto Sans CJK TC' ELSE 'Noto Sans CJK SC' END ELSE 'body' END".format(t=_T, s=_S)


@query("text_f25_run_fonts", f"SELECT doc_id, font, count(*) AS n FROM (SELECT doc_id, {_FONTS} AS font FROM runs WHERE text IS NOT NULL) GROUP BY ALL")
def text_f25_run_fonts(spark, d):
    """How many runs of a document take which East Asian font; Arabic script has its own attribute beside it."""
    han = (F.col("script") == "Han") | F.col("text").rlike("[㐀-鿿]")
    font = F.when(F.coalesce(han, F.lit(False)), F.when(ru.han_variant(F.col("text")) == "TC", "Noto Sans CJK TC").otherwise("Noto Sans CJK SC")).otherwise("body")
    return table(spark, d, "runs").where("text is not null").groupBy("doc_id", font.alias("font")).agg(F.count("*").alias("n"))


_AVAILABLE = [("eng",), ("rus",), ("kaz",), ("ara",), ("Latin",), ("Arabic",), ("chi_sim",), ("HanS",), ("osd",)]


@query(
    "report_f30_capabilities",
    f"""WITH spec AS {values('language, script, model', ru.LANGUAGES)}, gen AS {values('script, model', ru.SCRIPT_MODELS)}, have AS {values('model', _AVAILABLE)},
      ready AS (SELECT script, bool_and(model IN (SELECT model FROM have)) AS generic FROM gen GROUP BY script)
      SELECT language, script, model IN (SELECT model FROM have) AS exact_model_ready, generic OR model IN (SELECT model FROM have) AS route_ready,
        CASE WHEN generic THEN 'generic_script' WHEN model IN (SELECT model FROM have) THEN 'exact_language' ELSE 'insufficient_fallback' END AS basis FROM spec JOIN ready USING (script)""",
)
def report_f30_capabilities(spark, d):
    """What each priority language can be read with, given the installed models: the registry as a dimension."""
    return ru.capabilities(spark, literal(spark, "model string", _AVAILABLE))


@query(
    "report_d5_statuses",
    f"SELECT coalesce(code, '(none)') AS code, coalesce(status, CASE WHEN code IS NULL THEN '200 OK' ELSE '500 Internal Server Error' END) AS status, count(*) AS n FROM journal LEFT JOIN {values('c, status', ru.STATUSES)} s ON code = s.c GROUP BY ALL",
)
def report_d5_statuses(spark, d):
    """Journal rows by refusal code and the status a client of the service gets."""
    s = literal(spark, "code string, status string", ru.STATUSES)  # fixed, a handful of rows
    status = F.coalesce("status", F.when(F.col("code").isNull(), "200 OK").otherwise("500 Internal Server Error"))
    return table(spark, d, "journal").join(F.broadcast(s), "code", "left").groupBy(F.coalesce("code", F.lit("(none)")).alias("code"), status.alias("status")).agg(F.count("*").alias("n"))


_SHAPES = [(1, 120.0, 40.0, 900, 4800), (2, 60.0, 58.0, 1000, 3480), (3, 50.0, 50.0, 1400, 2500), (4, 30.0, 200.0, 100, 6000), (5, 300.0, 100.0, 9000, 30000), (6, 20.0, 20.0, 10, 400), (7, 0.0, 0.0, 0, 0)]


@query(
    "role_i26_coloured_graphics",
    f"""SELECT id, CASE WHEN w / greatest(1.0, h) >= 2.4 AND h <= 90 THEN 'signature' WHEN w / greatest(1.0, h) BETWEEN 0.65 AND 1.45 AND w >= 22 AND h >= 22 AND pixels / greatest(1, area) < 0.4 THEN 'seal'
      WHEN pixels / greatest(1, area) >= 0.22 THEN 'logo' ELSE 'graphic' END AS role FROM {values('id, w, h, pixels, area', _SHAPES)}""",
)
def role_i26_coloured_graphics(spark, d):
    """The role of a coloured graphic by its aspect, size and density."""
    s = literal(spark, "id int, w double, h double, pixels int, area int", _SHAPES)
    return s.select("id", ru.graphic_role(F.col("w"), F.col("h"), F.col("pixels"), F.col("area")).alias("role"))


_TAJIK = [(1, "ҷӯй"), (2, "Ҷамъ"), (3, "Ӣд ва ҷашн"), (4, "ӯ ӯ ӯ"), (5, "сад"), (6, None), (7, "")]


@query("script_f13_tajik_evidence", f"SELECT id, coalesce((CASE WHEN contains(lower(t), 'ҷ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'ӯ') THEN 1 ELSE 0 END + CASE WHEN contains(lower(t), 'ӣ') THEN 1 ELSE 0 END) >= 2, false) AS evidence FROM {values('id, t', _TAJIK)}")
def script_f13_tajik_evidence(spark, d):
    """Whether a text shows two of the three letters that only Tajik has."""
    return literal(spark, "id int, t string", _TAJIK).select("id", ru.tajik_evidence(F.col("t")).alias("evidence"))


@query(
    "func_m13_ocr_scale",
    f"""WITH h AS (SELECT doc_id, page, median(y1 - y0) * 200 / 72 AS h FROM words WHERE text IS NOT NULL GROUP BY ALL)
      SELECT doc_id, page, {R("CASE WHEN h <= 0 THEN 1.0 WHEN h < 14 THEN least(3.0, 14 / h) WHEN h > 24 THEN 20 / h ELSE 1.0 END")} AS factor FROM h""",
)
def func_m13_ocr_scale(spark, d):
    """The factor by which a page of 200 dpi is scaled for reading, by its median letter height."""
    h = table(spark, d, "words").where("text is not null").groupBy(*PAGE).agg((F.median(g.height()) * 200 / 72).alias("h"))
    return h.select(*PAGE, g.rounded(ru.ocr_scale(F.col("h"))).alias("factor"))


_SPEEDS = [(1, 330.0), (2, 100.0), (3, 660.0), (4, 99000.0), (5, None), (6, 0.0)]


@query("func_m14_speed_factor", f"SELECT id, least(20.0, greatest(0.5, coalesce(ms, 330.0) / 330.0)) AS factor FROM {values('id, ms', _SPEEDS)}")
def func_m14_speed_factor(spark, d):
    """How much slower a machine is than the reference, within half and twenty; unmeasured counts as equal."""
    return literal(spark, "id int, ms double", _SPEEDS).select("id", ru.speed_factor(F.col("ms")).alias("factor"))


_OPTIONS = [(1, "Latin, Cyrillic", "10", "8"), (2, "", None, None), (3, "Latin,Greek", "5", "9.5"), (4, "Han , Han,Arabic", "x", "8"), (5, None, "0", "-1")]


@query(
    "src_s24_settings",
    f"""WITH p AS (SELECT *, list_distinct(list_filter(list_transform(string_split(coalesce(scripts, ''), ','), lambda x: trim(x)), lambda x: x <> '')) AS s FROM {values('id, scripts, max_pages, min_letter_px', _OPTIONS)})
      SELECT id, CASE WHEN len(s) = 0 THEN 'Cyrillic+Latin' ELSE array_to_string(list_sort(s), '+') END AS scripts, coalesce(try_cast(max_pages AS INT), CASE WHEN max_pages IS NULL THEN 10 END) AS max_pages,
        CASE WHEN len(list_filter(s, lambda x: x NOT IN ('Latin', 'Cyrillic', 'Arabic', 'Han'))) > 0 THEN 'unknown script' WHEN max_pages IS NOT NULL AND coalesce(try_cast(max_pages AS INT), 0) < 1 THEN 'max_pages' WHEN min_letter_px IS NOT NULL AND coalesce(try_cast(min_letter_px AS DOUBLE), 0) <= 0 THEN 'min_letter_px' ELSE 'none' END AS problem FROM p""",
)
def src_s24_settings(spark, d):
    """Option rows with their defaults and the first option that is not valid."""
    return ru.settings(literal(spark, "id int, scripts string, max_pages string, min_letter_px string", _OPTIONS))


# ---------------------------------------------------------------- sinks and reports of the journal


@query(
    "sink_s14_refusals",
    """SELECT code, reason, count(*) AS n, count(message) AS n_messages, max(length(details)) AS longest FROM
      (SELECT coalesce(code, '(none)') AS code, coalesce(reason, code, '(none)') AS reason, message, details FROM journal WHERE outcome = 'refused') GROUP BY ALL""",
)
def sink_s14_refusals(spark, d):
    """Refused deliveries written apart, as JSON partitioned by code, and read back."""
    return ru.refusals(table(spark, d, "journal")).groupBy("code", "reason").agg(F.count("*").alias("n"), F.count("message").alias("n_messages"), F.max(F.length("details")).alias("longest"))


@query(
    "sink_s16_benchmark",
    f"""WITH r AS (SELECT file AS case_id, CASE WHEN batch_no % 5 = 0 THEN 'warmup' ELSE 'measured' END AS phase, seconds * 1000 AS ms, outcome, code, pages FROM journal WHERE file IS NOT NULL AND seconds IS NOT NULL)
      SELECT case_id, count(*) AS runs, {R("min(ms)", 1000)} AS fastest_ms, {R("median(ms)", 1000)} AS median_ms, {R("max(ms)", 1000)} AS slowest_ms, count(*) FILTER (outcome <> 'issued') AS quality_failures, count(code) AS errors,
        coalesce(sum(pages) FILTER (code IS NOT NULL), 0)::BIGINT AS retry_pages FROM r WHERE phase = 'measured' GROUP BY case_id""",
)
def sink_s16_benchmark(spark, d):
    """Runs written as JSON lines and summed up per case over the measured phase (every fifth batch is a warm-up)."""
    j = table(spark, d, "journal").where("file is not null and seconds is not null")
    runs = j.select(F.col("file").alias("case_id"), F.when(F.col("batch_no") % 5 == 0, "warmup").otherwise("measured").alias("phase"), (F.col("seconds") * 1000).alias("total_ms"), (F.col("outcome") == "issued").alias("expectation_met"), F.col("code").alias("error"), F.when(F.col("code").isNotNull(), F.col("pages")).alias("retry_pages"))
    return ru.benchmark_summary(ru.benchmark_runs(runs))


@query(
    "sink_s23_log_lines",
    "SELECT coalesce(code, '(none)') AS code, count(*) AS n, count(*) FILTER (json_extract_string(details, '$.stage') IS NOT NULL) AS staged, count(*) FILTER (json_extract_string(details, '$.page_index') IS NOT NULL) AS paged, sum(round(seconds * 1000))::BIGINT AS ms FROM journal GROUP BY ALL",
)
def sink_s23_log_lines(spark, d):
    """One JSON line a delivery, without any content, read back and counted."""
    lines = ru.log_lines(table(spark, d, "journal"))
    r = lines.select(F.from_json("line", "code string, stage string, page string, ms bigint").alias("r")).select("r.*")
    return r.groupBy(F.coalesce("code", F.lit("(none)")).alias("code")).agg(F.count("*").alias("n"), F.count("stage").alias("staged"), F.count("page").alias("paged"), F.sum("ms").alias("ms"))


# ---------------------------------------------------------------- gates

_GATES = "page_id, structure, garbled, lost, letters, regions, weak_cells"
_PAGES = [
    (1, 0, 0, 0.0, 1.0, 0, 0), (2, 1, 5, 0.5, 0.1, 3, 2), (3, 0, 2, 0.0, 1.0, 0, 0), (4, 0, 1, 0.11, 0.5, 0, 0), (5, 0, 1, 0.1, 0.79, 0, 0), (6, 0, 0, 0.1, 0.8, 1, 1), (7, 0, 0, None, None, 0, 4), (8, None, None, None, 0.0, None, None),
]


@query(
    "gate_p15_readability",
    f"""SELECT page_id, CASE WHEN coalesce(structure, 0) > 0 THEN 'unreliable_structure' WHEN coalesce(garbled, 0) >= 2 OR coalesce(lost, 0.0) > 0.1 THEN 'text_unreadable' WHEN coalesce(letters, 1.0) < 0.8 AND coalesce(letters, 1.0) > 0 THEN 'text_not_read'
      WHEN coalesce(regions, 0) > 0 THEN 'unrecognized_text' WHEN coalesce(weak_cells, 0) > 0 THEN 'unresolved_table_cells' ELSE 'none' END AS reason FROM {values(_GATES, _PAGES)}""",
)
def gate_p15_readability(spark, d):
    """The first failing gate of a page: structure, garbled words, lost text, letters read (a measured zero means unmeasured), skipped regions, weak cells."""
    return ru.first_failing(literal(spark, "page_id int, structure int, garbled int, lost double, letters double, regions int, weak_cells int", _PAGES))


@query(
    "gate_p15_measured_pages",
    f"""WITH {LIST}, w AS (SELECT doc_id, page, word_no, text, {TOK} AS token, coalesce(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END, 0) AS c FROM words WHERE regexp_matches(text, '\\p{{L}}')),
      s AS (SELECT doc_id, page, count(*) AS n, count(*) FILTER (regexp_matches(text, '[\\p{{L}}][%^~|{{}}<>\\\\#=+*]+[\\p{{L}}]')) AS garbled, count(*) FILTER (c < 0.5 AND token NOT IN (SELECT word FROM list)) AS lost FROM w GROUP BY ALL)
      SELECT doc_id, page, n, garbled, lost, CASE WHEN garbled >= 2 OR lost * 1.0 / greatest(1, n) > 0.1 THEN 'text_unreadable' ELSE 'none' END AS reason FROM s""",
)
def gate_p15_measured_pages(spark, d):
    """Garbled and lost tokens of a page and the gate they fail (G18: the lost share of its lettered words)."""
    s = ru.lost_tokens(table(spark, d, "words"), table(spark, d, "lexicon"))
    z = s.select(*PAGE, "n", "garbled", "lost", F.lit(0).alias("structure"), F.col("lost").alias("k")).withColumn("lost", F.col("k") / F.greatest(F.lit(1), F.col("n")))
    out = ru.first_failing(z.withColumns({"letters": F.lit(1.0), "regions": F.lit(0), "weak_cells": F.lit(0)}), keep=[*PAGE, "n", "garbled", "k"])
    return out.withColumnRenamed("k", "lost")


@query(
    "gate_p16_empty_pages",
    f"""WITH {WORDS_TOO}, {PLAN_TOO}, p AS (SELECT doc_id, page, max(route) AS route FROM plan_too GROUP BY ALL), w AS (SELECT doc_id, page, count(*) AS n FROM words_too GROUP BY ALL), b AS (SELECT doc_id, page, count(*) FILTER (block_type = 'graphic') AS n FROM blocks GROUP BY ALL)
      SELECT doc_id, page, route FROM p LEFT JOIN w USING (doc_id, page) LEFT JOIN b USING (doc_id, page) WHERE route <> 'BLANK' AND coalesce(w.n, 0) = 0 AND coalesce(b.n, 0) = 0 AND doc_id IN (SELECT doc_id FROM words_too)""",
)
def gate_p16_empty_pages(spark, d):
    """Pages of recognised documents that are not blank by plan and have neither words nor graphics."""
    words = words_too(spark, d)
    p = plan_too(spark, d).groupBy(*PAGE).agg(F.max("route").alias("route")).where("route <> 'BLANK'").join(words.select("doc_id").distinct(), "doc_id", "left_semi")
    return p.join(words, PAGE, "left_anti").join(table(spark, d, "blocks").where("block_type = 'graphic'"), PAGE, "left_anti").select(*PAGE, "route")


# ---------------------------------------------------------------- near words and verdicts


@query(
    "lex_l2_near_known",
    f"""WITH {LIST}, t AS (SELECT DISTINCT token FROM (SELECT {TOK} AS token FROM words WHERE text IS NOT NULL) WHERE length(token) >= 4 AND token NOT IN (SELECT word FROM list)),
      i AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t), p AS {values('a, b', [(x[0], x[1]) for q in lex.LOOKALIKE_PAIRS for x in (q, q[::-1])])},
      v AS (SELECT token, substr(token, 1, i - 1) || b || substr(token, i + 1) AS word FROM i JOIN p ON substr(token, i, 1) = a UNION SELECT token, substr(token, 2) FROM t
        UNION SELECT token, word FROM t JOIN list ON length(word) = length(token) + 1 AND list_contains(list_transform(range(3, length(token) + 1), lambda k: substr(word, 1, k - 1) || substr(word, k + 1)), token))
      SELECT token, min(word) AS word FROM v WHERE length(word) >= 3 AND word IN (SELECT word FROM list) GROUP BY token""",
)
def lex_l2_near_known(spark, d):
    """Unlisted tokens that a typical slip parts from a list word: a look-alike, a stray first letter, a lost letter inside."""
    words = lex.word_list(table(spark, d, "lexicon"))
    t = lex.token_counts(table(spark, d, "words")).join(words, F.col("token") == F.col("word"), "left_anti")
    return lex.near_known(t.select("token"), words)


@query(
    "lex_l3_near_russian",
    f"""WITH r AS (SELECT DISTINCT lower(word) AS word FROM lexicon WHERE lang = 'ru' AND length(word) >= 3), t AS (SELECT DISTINCT token FROM (SELECT {TOK} AS token FROM words WHERE text IS NOT NULL) WHERE regexp_matches(token, '^[а-яё]{{2,}}$') AND token NOT IN (SELECT word FROM r)),
      f AS (SELECT token, unnest(list_distinct(list_append(list_transform(range(1, length(token) + 1), lambda k: substr(token, 1, k - 1) || substr(token, k + 1)), token))) AS form FROM t),
      w AS (SELECT word, unnest(list_distinct(list_append(list_transform(range(1, length(word) + 1), lambda k: substr(word, 1, k - 1) || substr(word, k + 1)), word))) AS form FROM r),
      c AS (SELECT DISTINCT token, word FROM f JOIN w USING (form)),
      e AS (SELECT token, word FROM c WHERE
        list_contains(list_transform(range(1, length(token) + 1), lambda k: substr(token, 1, k - 1) || substr(token, k + 1)), word) OR list_contains(list_transform(range(1, length(word) + 1), lambda k: substr(word, 1, k - 1) || substr(word, k + 1)), token)
        OR length(token) = length(word) AND (len(list_filter(range(1, length(token) + 1), lambda k: substr(token, k, 1) <> substr(word, k, 1))) = 1
          OR list_contains(list_transform(range(1, length(token)), lambda k: substr(token, 1, k - 1) || substr(token, k + 1, 1) || substr(token, k, 1) || substr(token, k + 2)), word)))
      SELECT token, min(word) AS word FROM e GROUP BY token""",
)
def lex_l3_near_russian(spark, d):
    """Cyrillic tokens one edit or one swap of neighbours from a Russian list word."""
    r = table(spark, d, "lexicon").where("lang = 'ru' and length(word) >= 3").select(F.lower("word").alias("word")).distinct()
    t = lex.token_counts(table(spark, d, "words")).where(F.col("token").rlike("^[а-яё]{2,}$")).join(r, F.col("token") == F.col("word"), "left_anti")
    return lex.near_pairs(t.select("token"), r).groupBy("token").agg(F.min("word").alias("word"))


_PUT = [(lang, k, x) for lang, t in lex.DIACRITICS.items() for k, v in t.items() for x in v]


@query(
    "lex_l4_diacritic_slips",
    f"""WITH l AS (SELECT DISTINCT lang, lower(word) AS word FROM lexicon WHERE word IS NOT NULL), p AS {values('lang, k, x', _PUT)},
      t AS (SELECT DISTINCT token FROM (SELECT {TOK} AS token FROM words WHERE text IS NOT NULL UNION SELECT translate(lower(word), 'қғңөұүәіһў', 'кгноууаиху') FROM lexicon WHERE lang IN ('kk', 'uz')) WHERE regexp_matches(token, '^\\p{{Cyrillic}}{{3,}}$') AND token NOT IN (SELECT word FROM l WHERE lang = 'ru')),
      i AS (SELECT token, unnest(range(1, length(token) + 1)) AS i FROM t),
      v AS (SELECT p.lang, token, substr(token, 1, i - 1) || x || substr(token, i + 1) AS word FROM i JOIN p ON substr(token, i, 1) = k)
      SELECT v.token, v.lang, min(v.word) AS word FROM v JOIN l ON l.lang = v.lang AND l.word = v.word WHERE NOT EXISTS (SELECT 1 FROM l o WHERE o.lang = v.lang AND o.word = v.token) GROUP BY v.token, v.lang""",
)
def lex_l4_diacritic_slips(spark, d):
    """Cyrillic tokens of the words, and list words bare of their diacritics, that one lost diacritic
    parts from a word of a language with diacritics."""
    bare = table(spark, d, "lexicon").where("lang in ('kk', 'uz')").select(F.translate(F.lower("word"), "қғңөұүәіһў", "кгноууаиху").alias("token"))
    t = lex.token_counts(table(spark, d, "words")).select("token").unionByName(bare).distinct()
    return lex.diacritic_slips(t, table(spark, d, "lexicon"))


_VERDICTS = [
    (1, "Стaтья", "", None, 0.95, False), (2, "ýylyňă", "", "ýylyňă", 0.99, False), (3, "слово", "другое", None, 0.95, False), (4, "з", "", None, 0.99, False), (5, "Ж", "Ж", None, 0.99, True), (6, "Ж", "", None, 0.99, True), (7, "м", "", None, 0.85, False),
    (8, "м", "", None, 0.85, True), (9, "таълимии", "таълимии", "таълими", 0.9, False), (10, "Раскулов", "Раскулов", None, 0.9, False), (11, "созданин", "созданин", "создании", 0.9, False), (12, "из", "", "из", 0.85, False), (13, "ир", "", None, 0.85, False),
    (14, "закон", "", "закон", 0.55, False), (15, "закон", "", "закон", 0.45, False), (16, "Шакиров", "", None, 0.85, False), (17, "шакиров", "", None, 0.85, False), (18, "қаласық", "", None, 0.86, False), (19, "нечитм", "", None, 0.5, False), (20, "кызыл", "", None, 0.87, False), (21, "", "", None, 0.9, False),
]


@query(
    "lex_l8_token_rules",
    f"""WITH k AS (SELECT DISTINCT word FROM {values('id, token, alternative, word, c, dotted', _VERDICTS)} WHERE word IS NOT NULL),
      pr AS {values('a, b', [(x[0], x[1]) for q in lex.LOOKALIKE_PAIRS for x in (q, q[::-1])])}, i AS (SELECT id, token, unnest(range(1, length(token) + 1)) AS i FROM {values('id, token, alternative, word, c, dotted', _VERDICTS)} WHERE length(token) >= 4),
      near AS (SELECT DISTINCT id FROM i JOIN pr ON substr(token, i, 1) = a WHERE substr(token, 1, i - 1) || b || substr(token, i + 1) IN (SELECT word FROM k)),
      t AS (SELECT *, alternative <> '' AND alternative = token AS agreed, alternative <> '' AND alternative <> token AS disagreed, token IN (SELECT word FROM k) AS known, id IN (18, 20) AS national,
        list_has_any(list_transform(list_filter(range(2, length(token) + 1), lambda i: substr(token, i, 1) = substr(token, i - 1, 1)), lambda i: substr(token, 1, i - 1) || substr(token, i + 1)), (SELECT list(word) FROM k)) AS doubled FROM {values('id, token, alternative, word, c, dotted', _VERDICTS)})
      SELECT id, CASE WHEN token = '' THEN 'ok' WHEN regexp_matches(token, '\\p{{Cyrillic}}') AND regexp_matches(token, '\\p{{Latin}}') THEN 'error' WHEN regexp_matches(regexp_replace(token, '[{ru.ALPHABET}-]', '', 'g'), '\\p{{L}}') THEN 'error' WHEN disagreed THEN 'error'
        WHEN length(token) = 1 THEN CASE WHEN token IN ('ы', 'ь', 'ъ', 'Ы', 'Ь', 'Ъ', 'з', 'З') THEN 'error' WHEN upper(token) = token AND dotted THEN CASE WHEN agreed THEN 'ok' ELSE 'error' END WHEN agreed OR c >= CASE WHEN dotted THEN 0.8 ELSE 0.9 END THEN 'ok' ELSE 'error' END
        WHEN doubled AND NOT known THEN 'error' WHEN agreed THEN CASE WHEN length(token) >= 4 AND NOT known AND NOT (regexp_matches(token, '^\\p{{Lu}}') AND regexp_matches(lower(token), '({ru.SURNAME})$')) AND id IN (SELECT id FROM near) THEN 'error' ELSE 'ok' END
        WHEN length(token) < 3 THEN CASE WHEN c >= 0.9 OR c >= 0.8 AND known THEN 'ok' ELSE 'error' END WHEN known THEN CASE WHEN c >= 0.5 THEN 'ok' ELSE 'error' END WHEN c < 0.6 THEN 'error'
        WHEN regexp_matches(token, '^\\p{{Lu}}(\\p{{Ll}}*|\\p{{Lu}}*)$') AND c >= 0.8 THEN 'unverified' WHEN regexp_matches(lower(token), '[{NATIONAL}]') AND c >= 0.85 THEN 'unverified' WHEN national AND c >= 0.85 THEN 'unverified' ELSE 'error' END AS verdict FROM t""",
)
def lex_l8_token_rules(spark, d):
    """Every token rule on rows made for it; the word list is that of the rows, the page national for 18 and 20."""
    t = literal(spark, "id int, token string, alternative string, word string, c double, dotted boolean", _VERDICTS)
    known = t.where("word is not null").select("word").distinct()
    near = lex.near_known(t.select("token").where("token <> ''").distinct(), known).select("token", F.lit(True).alias("near"))
    t = t.join(known.select(F.col("word").alias("token"), F.lit(True).alias("k")), "token", "left").join(ru.doubled(t.select("token").distinct(), known), "token", "left").join(near, "token", "left")
    f = lambda c: F.coalesce(F.col(c), F.lit(False))
    return t.select("id", ru.token_verdict(F.col("token"), F.col("c"), f("k"), f("doubled"), f("near"), F.col("alternative"), F.col("dotted"), F.col("id").isin(18, 20)).alias("verdict"))


@query(
    "lex_l8_word_verdicts",
    f"""WITH {LIST}, w AS (SELECT doc_id, page, word_no, text, alternative, {TOK} AS token, coalesce(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END, 0) AS c FROM words WHERE text IS NOT NULL),
      nat AS (SELECT doc_id, page, count(*) FILTER (regexp_matches(lower(text), '[{NATIONAL}]')) >= greatest(3, 0.05 * count(*)) AS national FROM words WHERE regexp_matches(text, '\\p{{L}}') GROUP BY ALL),
      part AS (SELECT doc_id, page, word_no, text, alternative, c, unnest(CASE WHEN contains(token, '-') THEN string_split(token, '-') ELSE [token] END) AS token, token AS whole FROM w),
      f AS (SELECT p.*, p.token IN (SELECT word FROM list) OR p.whole IN (SELECT word FROM list) AS known, coalesce(national, false) AS national, alternative <> '' AND alternative = text AS agreed, alternative <> '' AND alternative <> text AS disagreed,
          substr(text, 1, 1) AS head, regexp_matches(text, '^\\P{{L}}*\\p{{Lu}}') AS cap FROM part p LEFT JOIN nat USING (doc_id, page)),
      v AS (SELECT doc_id, page, word_no, CASE WHEN regexp_matches(text, '(?i)@|https?:|www\\.') THEN CASE WHEN disagreed THEN 2 ELSE 0 END
          WHEN regexp_replace(text, '[^\\p{{Nd}}]', '', 'g') <> regexp_replace(alternative, '[^\\p{{Nd}}]', '', 'g') AND alternative <> '' THEN 2
          WHEN NOT regexp_matches(text, '\\p{{L}}') THEN CASE WHEN agreed THEN 0 WHEN regexp_matches(text, '\\p{{Nd}}') AND c < 0.7 OR c < 0.3 AND length(text) > 2 THEN 2 ELSE 0 END
          WHEN regexp_matches(text, '[%^~|{{}}<>\\\\#=+*]') THEN 2 WHEN regexp_matches(token, '\\p{{Cyrillic}}') AND regexp_matches(token, '\\p{{Latin}}') THEN 2 WHEN disagreed THEN 2
          WHEN length(token) = 1 THEN CASE WHEN token IN ('ы', 'ь', 'ъ', 'з') THEN 2 WHEN agreed OR c >= 0.9 THEN 0 ELSE 2 END WHEN agreed THEN 0 WHEN length(token) < 3 THEN CASE WHEN c >= 0.9 OR c >= 0.8 AND known THEN 0 ELSE 2 END
          WHEN known THEN CASE WHEN c >= 0.5 THEN 0 ELSE 2 END WHEN c < 0.6 THEN 2 WHEN cap AND c >= 0.8 THEN 1 WHEN (regexp_matches(token, '[{NATIONAL}]') OR national) AND c >= 0.85 THEN 1 ELSE 2 END AS rank FROM f)
      SELECT doc_id, page, count(*) AS n, count(*) FILTER (worst = 1) AS unverified, count(*) FILTER (worst = 2) AS errors, {R("count(*) FILTER (worst = 2) / greatest(1, count(*))")} AS error_share FROM (SELECT doc_id, page, word_no, max(rank) AS worst FROM v GROUP BY ALL) GROUP BY ALL""",
)
def lex_l8_word_verdicts(spark, d):
    """Verdicts of whole words: exemptions and numbers first, then the worst of the parts between hyphens; counts and shares per page (L9, G16)."""
    return ru.word_verdicts(table(spark, d, "words"), table(spark, d, "lexicon"))


# ---------------------------------------------------------------- normalisation, joins of halves, dropped lines

_MOVES = [
    (1, "2024r.", "Cyrillic", False), (2, "r.", "Cyrillic", False), (3, "2019года", "Cyrillic", False), (4, "2024il", "Latin", False), (5, "у.", "Latin", False), (6, "C", "Cyrillic", False), (7, "K", "Cyrillic", True), (8, "K", "Cyrillic", False), (9, "Ne", "Cyrillic", True),
    (10, "Koʻʻchasi", "Latin", False), (11, "Ko“chasi", "Latin", False), (12, "ten.:", "Cyrillic", False), (13, "Стaтья", "Cyrillic", False), (14, "рaper", "Latin", False), (15, "word", "Latin", False), (16, None, "Latin", False),
]


@query("text_f17_normalised", f"""WITH m AS {values('id, text, line, national', _MOVES)}, a AS (SELECT *, regexp_replace(regexp_replace(text, '[ʻ‘’''`]{{2,}}', 'ʻ', 'g'), '(\\p{{L}})[“”](\\p{{L}})', '\\1ʻ\\2', 'g') AS t FROM m),
      b AS (SELECT *, length(regexp_replace(t, '[^\\p{{L}}]', '', 'g')) AS n, length(regexp_replace(t, '[^\\p{{Latin}}]', '', 'g')) AS la, length(regexp_replace(t, '[^\\p{{Cyrillic}}]', '', 'g')) AS cy FROM a)
      SELECT id, CASE WHEN regexp_matches(t, '^(N[eoº°]|No\\.?|N)$') THEN '№' WHEN line = 'Cyrillic' AND regexp_matches(t, '^\\d+r\\.?[,;]?$') THEN replace(t, 'r', ' г') WHEN line = 'Cyrillic' AND regexp_matches(t, '^r\\.[,;]?$') THEN replace(t, 'r', 'г')
        WHEN regexp_matches(t, '^(19|20)\\d\\d\\p{{L}}+\\.?[,;:]?$') THEN substr(t, 1, 4) || ' ' || substr(t, 5)
        WHEN line = 'Cyrillic' AND regexp_matches(t, '^[Tt]en\\.?:?$') THEN translate(t, 'Tten', 'Ттел')
        WHEN line = 'Latin' AND n = 1 AND cy = 1 THEN translate(t, 'АВСЕНКМОРТХасеорху', 'ABCEHKMOPTXaceopxy') WHEN line = 'Cyrillic' AND n = 1 AND la = 1 THEN CASE WHEN national THEN translate(t, 'ABCEMPTacep', 'АВСЕМРТасер') ELSE translate(t, 'ABCEMPTacepKOHoy', 'АВСЕМРТасерКОНоу') END
        WHEN la > 0 AND cy > la THEN translate(t, '{ru.LATIN_LIKE}', '{ru.CYRILLIC_LIKE}') WHEN cy > 0 AND la > cy THEN translate(t, '{ru.CYRILLIC_LIKE}', '{ru.LATIN_LIKE}') ELSE t END AS text FROM b""")
def text_f17_normalised(spark, d):
    """Look-alikes of reading set right by the alphabet of the line: number signs, years, lone letters, mixed words, apostrophes."""
    m = literal(spark, "id int, text string, line string, national boolean", _MOVES)
    return m.select("id", ru.normalised(F.col("text"), F.col("line"), F.col("national")).alias("text"))


@query(
    "lex_l12_dropped_lines",
    f"""WITH {WORDS_TOO}, {LIST}, k AS (SELECT *, array_to_string(line_id, '-') AS line_key, coalesce(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END, 0) < 0.8 AND {TOK} NOT IN (SELECT word FROM list) AS doubtful FROM words_too WHERE text IS NOT NULL AND len(line_id) > 0),
      body AS (SELECT doc_id, page, median(y1 - y0) AS body, 0.12 * max(y1) AS top, 0.85 * max(y1) AS bottom FROM k GROUP BY ALL),
      l AS (SELECT doc_id, page, line_key, count(*) AS n, count(*) FILTER (doubtful) AS doubtful, median(y1 - y0) AS h, min(y0) AS y0, max(y1) AS y1 FROM k GROUP BY ALL)
      SELECT doc_id, page, line_key, n, doubtful, h < 0.8 * body AS small FROM l JOIN body USING (doc_id, page) WHERE doubtful >= 0.5 * n AND (h < 0.8 * body OR (n >= 6 AND (l.y1 < top OR l.y0 > bottom)))""",
)
def lex_l12_dropped_lines(spark, d):
    """Lines that a restored page drops: small print, or long lines at the edge of the page, with half of their words in doubt."""
    return ru.junk_lines(words_too(spark, d), table(spark, d, "lexicon"))


@query(
    "sort_o8_repair_pages",
    "SELECT doc_id, page, count(*) AS n FROM words WHERE confidence < 0.8 AND NOT isnan(confidence) AND text IS NOT NULL GROUP BY ALL HAVING count(*) <= 30",
)
def sort_o8_repair_pages(spark, d):
    """Pages whose weak words are few enough to be read again one by one; a page above thirty is left as it is."""
    w = table(spark, d, "words").where("confidence < 0.8 and not isnan(confidence) and text is not null")
    return w.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n <= 30")


_ONE = lambda c: f"trim(regexp_replace(nfc_normalize({c}), '[\\s\\p{{Z}}]+', ' ', 'g'))"


@query(
    "text_f9_unicode_error_rates",
    f"""WITH p AS (SELECT doc_id, page, word_no, {_ONE('alternative')} AS e, {_ONE('text')} AS a FROM words WHERE text IS NOT NULL AND alternative <> '')
      SELECT doc_id, page, word_no, {R(f"({edit_distance('e', 'a')}) / greatest(1, length(e))")} AS rate FROM p""",
)
def text_f9_unicode_error_rates(spark, d):
    """Error rates of second readings over composed text with marks and digits."""
    w = table(spark, d, "words").where("text is not null and alternative <> ''")
    return w.select(*PAGE, "word_no", g.rounded(tx.unicode_error_rate(F.col("alternative"), F.col("text"))).alias("rate"))


# ---------------------------------------------------------------- pictures, columns, tables on literal geometry

_PIC = [(1, 1, 100.0, 100.0, 200.0, 200.0)]
_PW = [
    (1, 1, 1, 110.0, 110.0, 150.0, 120.0, 0.9), (1, 2, 1, 155.0, 110.0, 190.0, 120.0, 0.9), (1, 3, 2, 120.0, 150.0, 180.0, 160.0, 0.9), (1, 4, 2, 210.0, 150.0, 260.0, 160.0, 0.8), (1, 5, 2, 265.0, 150.0, 300.0, 160.0, 0.75), (1, 6, 3, 120.0, 180.0, 180.0, 190.0, 0.9), (1, 7, 3, 20.0, 180.0, 90.0, 190.0, 0.9),
    (2, 8, 1, 110.0, 110.0, 150.0, 120.0, 0.9), (1, 9, 4, 300.0, 300.0, 350.0, 310.0, 0.2), (1, 10, 3, 205.0, 180.0, 290.0, 190.0, 0.5),
]


@query(
    "join_j6_words_in_pictures",
    f"""WITH w AS {values('page, word_no, line_no, x0, y0, x1, y1, c', _PW)}, p AS {values('page, pic_no, px0, py0, px1, py1', _PIC)},
      i AS (SELECT w.*, EXISTS (SELECT 1 FROM p WHERE p.page = w.page AND (x0 + x1) / 2 BETWEEN px0 AND px1 AND (y0 + y1) / 2 BETWEEN py0 AND py1) AS inside FROM w)
      SELECT page, word_no FROM i WHERE NOT (inside AND (SELECT count(*) FROM i o WHERE o.page = i.page AND o.line_no = i.line_no AND NOT o.inside AND o.c >= 0.75) < 2)""",
)
def join_j6_words_in_pictures(spark, d):
    """Words but for those inside a picture; a line that goes on outside with two words and more keeps its own."""
    w = literal(spark, "page int, word_no int, line_no int, x0 double, y0 double, x1 double, y1 double, c double", _PW)
    p = literal(spark, "page int, pic_no int, px0 double, py0 double, px1 double, py1 double", _PIC)
    return ru.outside_pictures(w, p).select("page", "word_no")


_COLS = [(1, 1, 50.0, 100.0, 250.0, 400.0), (1, 2, 400.0, 100.0, 550.0, 400.0), (2, 1, 50.0, 100.0, 250.0, 400.0)]
_GR = [(1, 1, 270.0, 150.0, 380.0, 300.0), (1, 2, 240.0, 150.0, 380.0, 300.0), (1, 3, 270.0, 500.0, 380.0, 600.0), (2, 4, 270.0, 150.0, 380.0, 300.0)]


@query(
    "join_j21_graphic_columns",
    f"""WITH c AS {values('page, col_no, x0, y0, x1, y1', _COLS)}, g AS {values('page, graphic_no, gx0, gy0, gx1, gy1', _GR)}
      SELECT g.page, graphic_no, a.col_no AS after_col FROM g JOIN c a ON a.page = g.page JOIN c b ON b.page = g.page AND b.col_no = a.col_no + 1
      WHERE gx0 >= a.x1 AND gx1 <= b.x0 AND (gy0 + gy1) / 2 BETWEEN least(a.y0, b.y0) - 4 AND greatest(a.y1, b.y1) + 4""",
)
def join_j21_graphic_columns(spark, d):
    """Graphics that stand between two neighbouring columns and so become a column of their own."""
    c = literal(spark, "page int, col_no int, x0 double, y0 double, x1 double, y1 double", _COLS)
    return ru.graphics_between(c, literal(spark, "page int, graphic_no int, gx0 double, gy0 double, gx1 double, gy1 double", _GR))


_CW = [(1, 1, 1, 0.0, 0.0, 10.0, 8.0, "Total"), (1, 2, 1, 20.0, 0.0, 40.0, 8.0, "(net"), (1, 3, 1, 45.0, 0.0, 60.0, 8.0, ")"), (1, 4, 2, 0.0, 10.0, 30.0, 18.0, "with-"), (1, 5, 2, 40.0, 10.0, 60.0, 18.0, "tax"), (2, 6, 3, 40.0, 0.0, 60.0, 8.0, "مرحبا"), (2, 7, 3, 0.0, 0.0, 30.0, 8.0, "بكم"), (3, 8, 4, 0.0, 0.0, 9.0, 8.0, "合"), (3, 9, 4, 10.0, 0.0, 19.0, 8.0, "计")]


@query("agg_g19_cell_text")
def agg_g19_cell_text(spark, d):
    """The text of a cell: lines from the top, words in the direction of their line, separators by script and mark (rows only: a fold; tested on these rows)."""
    w = literal(spark, "cell_no int, word_no int, line_no int, x0 double, y0 double, x1 double, y1 double, text string", _CW)
    return ru.cell_text(w)


_INV = [("a", 1, 0, 600.0, 800.0), ("a", 2, 1, 600.0, 800.0), ("a", 3, 1, 600.0, 800.0), ("b", 1, 0, 0.0, 800.0), ("b", 2, 1, 600.0, float("1e9")), ("c", 1, 0, 600.0, 800.0)]
_INVB = [
    ("a", 1, 1, "paragraph", 10.0, 10.0, 50.0, 20.0, 1, "x", 5), ("a", 1, 2, "paragraph", 50.0, 10.0, 10.0, 20.0, 1, "x", 5), ("a", 1, 3, "graphic", 5.0, 5.0, 9.0, 9.0, 1, None, 0), ("a", 1, 4, "graphic", 5.0, 5.0, 9.0, 9.0, 1, None, 9), ("c", 1, 1, "paragraph", 10.0, 10.0, 50.0, 20.0, 7, "x", 5), ("c", 1, 2, "paragraph", -9.0, 10.0, 50.0, 20.0, 1, "x", 5),
]


@query(
    "quality_q1_model_rules",
    f"""WITH p AS {values('doc, page, idx, w, h', _INV)}, b AS {values('doc, page, item, kind, x0, y0, x1, y1, source, text, bytes', _INVB)}
      SELECT 'duplicate_page_index' AS code, doc, min(page) AS page, -1 AS item FROM p GROUP BY doc, idx HAVING count(*) > 1
      UNION ALL SELECT 'page_geometry', doc, page, -1 FROM p WHERE w <= 0 OR h <= 0 OR w > 20000 OR h > 20000
      UNION ALL SELECT 'block_geometry', doc, page, item FROM b WHERE x1 <= x0 OR y1 <= y0
      UNION ALL SELECT 'outside_page', b.doc, b.page, item FROM b JOIN p ON p.doc = b.doc AND p.page = b.page WHERE x0 < -2 OR y0 < -2 OR x1 > w + 2 OR y1 > h + 2
      UNION ALL SELECT 'provenance', doc, page, item FROM b WHERE source <> page
      UNION ALL SELECT 'empty_graphic', doc, page, item FROM b WHERE kind = 'graphic' AND coalesce(bytes, 0) = 0""",
)
def quality_q1_model_rules(spark, d):
    """The invariants of pages, boxes, provenance and graphics on rows that break each of them."""
    p = literal(spark, "doc string, page int, idx int, w double, h double", _INV)
    b = literal(spark, "doc string, page int, item int, kind string, x0 double, y0 double, x1 double, y1 double, source int, text string, bytes int", _INVB)
    return ru.model_issues(p, b)


_BANDS = [(1, 1, 1, 50.0, 10.0, 90.0, 20.0), (1, 1, 2, 200.0, 10.0, 260.0, 20.0), (1, 2, 1, 52.0, 30.0, 95.0, 40.0), (1, 2, 2, 205.0, 30.0, 250.0, 40.0), (1, 3, 1, 50.0, 90.0, 300.0, 100.0), (1, 4, 1, 50.0, 110.0, 90.0, 120.0), (1, 4, 2, 200.0, 110.0, 250.0, 120.0), (1, 5, 1, 51.0, 125.0, 93.0, 135.0), (1, 5, 2, 210.0, 125.0, 255.0, 135.0), (1, 6, 1, 52.0, 140.0, 80.0, 150.0)]


@query("win_w6_bands")
def win_w6_bands(spark, d):
    """Bands of rows with several segments: a row joins while its segments fit the band's slots and it follows within 1.8 heights; a
    row of one segment may end a band (rows only: order-dependent; tested on these rows)."""
    rows = literal(spark, "page int, row_no int, segment_no int, x0 double, y0 double, x1 double, y1 double", _BANDS)
    return ru.bands(rows)


_DIGITS_AR = [(1, "ص١٢٣", [5.0, 10.0, 20.0, 30.0]), (2, "ص١٢٣", [40.0, 30.0, 20.0, 10.0]), (7, "١٢٣", [30.0, 20.0, 10.0]), (8, "ص١١", [9.0, 8.0, 7.0]), (3, "أ١٢ب٣٤", [1.0, 5.0, 9.0, 12.0, 20.0, 16.0]), (4, "abc", [1.0, 2.0, 3.0]), (5, "٧", [4.0]), (6, None, None)]


@query("text_f35_digit_order")
def text_f35_digit_order(spark, d):
    """Runs of Arabic-Indic digits whose places run against their order (digits run left to right in every script; rows only, tested on these rows)."""
    s = literal(spark, "id int, text string, centres array<double>", _DIGITS_AR)
    return s.select("id", ru.digit_anomalies(F.col("text"), F.col("centres")).alias("anomalies"))



@query(
    "text_f23_trimmed_runs",
    """WITH p AS (SELECT doc_id, page, block_no, length(list_marker) AS n FROM blocks WHERE list_marker IS NOT NULL AND starts_with(text, list_marker)),
      r AS (SELECT r.doc_id, r.page, r.block_no, run_no, coalesce(r.text, '') AS text, coalesce(n, 3) AS n, sum(length(coalesce(r.text, ''))) OVER (PARTITION BY r.doc_id, r.page, r.block_no ORDER BY run_no) AS e
        FROM runs r LEFT JOIN p USING (doc_id, page, block_no)),
      t AS (SELECT *, greatest(0, n - (e - length(text)))::INT AS k FROM r)
      SELECT doc_id, page, block_no, run_no, substr(text, k + 1) AS text FROM t WHERE k < length(text)""",
)
def text_f23_trimmed_runs(spark, d):
    """Runs of blocks without the block's list marker, or without three characters where it has none before its text."""
    keys = [*PAGE, "block_no"]
    own = table(spark, d, "blocks").where("list_marker is not null and startswith(text, list_marker)").select(*keys, F.length("list_marker").alias("m"))
    runs = table(spark, d, "runs").select(*keys, "run_no", "text")
    prefix = runs.select(*keys).distinct().join(own, keys, "left").select(*keys, F.coalesce("m", F.lit(3)).alias("n_prefix"))
    return ru.trimmed_runs(runs, prefix, keys)


_TC = [(1, 0, 0, 0.0, 0.0, 50.0, 10.0), (1, 0, 1, 50.0, 0.0, 100.0, 10.0), (1, 1, 0, 0.0, 10.0, 50.0, 20.0), (1, 1, 1, 50.0, 10.0, 100.0, 20.0), (2, 0, 0, 0.0, 0.0, 50.0, 10.0), (2, 0, 1, 50.0, 0.0, 100.0, 10.0)]
_SP = [(1, 1, 2.0, 1.0, 45.0, 9.0), (1, 2, 2.0, 11.0, 80.0, 19.0), (1, 3, 2.0, 11.0, 52.0, 19.0), (1, 4, 2.0, 30.0, 90.0, 39.0), (2, 5, 2.0, 9.5, 98.0, 18.0)]


@query(
    "join_p19_split_spans",
    f"""WITH c AS {values('table_id, row_no, col_no, x0, y0, x1, y1', _TC)}, s AS {values('table_id, span_no, sx0, sy0, sx1, sy1', _SP)}
      SELECT DISTINCT table_id, span_no FROM (SELECT c.table_id, row_no, span_no FROM c JOIN s USING (table_id) WHERE least(y1, sy1) - greatest(y0, sy0) >= least(2.0, (y1 - y0) * 0.25)
        AND least(x1, sx1) - greatest(x0, sx0) >= least(5.0, (x1 - x0) * 0.12) GROUP BY c.table_id, row_no, span_no HAVING count(*) >= 2)""",
)
def join_p19_split_spans(spark, d):
    """Spans of running text that a fabricated grid cuts into several cells of one row (made rows)."""
    c = literal(spark, "table_id int, row_no int, col_no int, x0 double, y0 double, x1 double, y1 double", _TC)
    return ru.split_spans(c, literal(spark, "table_id int, span_no int, sx0 double, sy0 double, sx1 double, sy1 double", _SP))

QUERIES, ORACLES = Q, O
