"""Rules over single words, runs, pages and journal rows as column expressions and joins.

Defined results: null texts hold nothing (false, no variant, 'ok'); a rule with an unmeasured input does not fail;
repeated rows count each; unknown codes and scripts have a named default."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions import geometry as g
from quirefold.functions import text as tx
from quirefold.operators import lexical as lex
from quirefold.session import work_path

PAGE = ["doc_id", "page"]

# Han characters written in one of the two systems only.
TRADITIONAL = "編號額審繼續體國學書門臺灣與為後發務東長車網電機報資產專業會議寫頁顯讀實際數據處"
SIMPLIFIED = "编号额审继续体国学书门台湾与为后发务东长车网电机报资产专业会议写页显读实际数据处"

# Language, script and the name of its recognition model; generic models by script.
LANGUAGES = [
    ("English", "Latin", "eng"), ("Uzbek Latin", "Latin", "uzb"), ("Turkmen", "Latin", "tkm"), ("Azerbaijani", "Latin", "aze"), ("Russian", "Cyrillic", "rus"), ("Kazakh", "Cyrillic", "kaz"), ("Kyrgyz", "Cyrillic", "kir"),
    ("Uzbek Cyrillic", "Cyrillic", "uzb_cyrl"), ("Tajik", "Cyrillic", "tgk"), ("Arabic", "Arabic", "ara"), ("Persian/Farsi", "Arabic", "fas"), ("Simplified Chinese", "Han", "chi_sim"), ("Traditional Chinese", "Han", "chi_tra"),
]
SCRIPT_MODELS = [("Latin", "Latin"), ("Cyrillic", "Cyrillic"), ("Arabic", "Arabic"), ("Han", "HanS"), ("Han", "HanT")]

# Refusal codes and what a client is told.
STATUSES = [
    ("INVALID_PDF", "400 Bad Request"), ("UPLOAD_TOO_LARGE", "413 Payload Too Large"), ("DOCUMENT_TOO_EXPENSIVE", "422 Unprocessable Content"), ("LANGUAGE_UNAVAILABLE", "422 Unprocessable Content"), ("UNREADABLE_DOCUMENT", "422 Unprocessable Content"),
    ("FAST_SLA_EXCEEDED", "504 Gateway Timeout"), ("SERVICE_BUSY", "503 Service Unavailable"), ("NOT_READY", "503 Service Unavailable"),
]

# Letters of the languages read, endings of surnames and patronymics, equal glyphs of the two alphabets.
ALPHABET = "abcdefghijklmnopqrstuvwxyzçəğıöşüäňýžABCDEFGHIJKLMNOPQRSTUVWXYZÇƏĞÖŞÜÄŇÝŽİабвгдеёжзийклмнопрстуфхцчшщъыьэюяәғқңөұүһіўҳӣӯҷАБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯӘҒҚҢӨҰҮҺІЎҲӢӮҶʻʼ"
SURNAME = "ов|ев|ёв|ин|ова|ева|ёва|ина|ову|еву|ину|овой|евой|иной|овым|евым|иным|ович|евич|овича|евича|овичу|евичу|овна|евна|ична|овны|евны|кызы|қызы|улы|ұлы|uly|qizi|ov|ev|ova|eva"
NEVER_ALONE = "ыьъЫЬЪзЗ"
LATIN_LIKE = "ABCEHKMOPTXYaceopxyƏəIi"
CYRILLIC_LIKE = "АВСЕНКМОРТХУасеорхуӘәІі"
LONE_ANYWHERE, LONE_RUSSIAN, LONE_LATIN = ("ABCEMPTacep", "АВСЕМРТасер"), ("KOHoy", "КОНоу"), ("АВСЕНКМОРТХасеорху", "ABCEHKMOPTXaceopxy")
# Letter heights in pixels that reading works best at, and the reference time of a page in milliseconds.
SMALL_PX, TALL_PX, SHRUNK_PX, MOST_SCALE = 14.0, 24.0, 20.0, 3.0
REFERENCE_MS, LEAST_FACTOR, MOST_FACTOR = 330.0, 0.5, 20.0


def han_variant(text: Column) -> Column:
    """TC or SC by characters only one variant has; null where both or neither occur."""
    t, s = text.rlike(f"[{TRADITIONAL}]"), text.rlike(f"[{SIMPLIFIED}]")
    return F.when(t & ~s, "TC").when(s & ~t, "SC")


def tajik_evidence(text: Column) -> Column:
    low = F.lower(text)
    return F.coalesce(sum((F.contains(low, F.lit(c)).cast("int") for c in "ҷӯӣ"), F.lit(0)) >= 2, F.lit(False))


def graphic_role(width: Column, height: Column, pixels: Column, area: Column) -> Column:
    aspect, density = width / F.greatest(F.lit(1.0), height), pixels / F.greatest(F.lit(1), area)
    return (
        F.when((aspect >= 2.4) & (height <= 90), "signature")
        .when(aspect.between(0.65, 1.45) & (width >= 22) & (height >= 22) & (density < 0.4), "seal")
        .when(density >= 0.22, "logo")
        .otherwise("graphic")
    )


def ocr_scale(height_px: Column) -> Column:
    return F.when(height_px <= 0, 1.0).when(height_px < SMALL_PX, F.least(F.lit(MOST_SCALE), SMALL_PX / height_px)).when(height_px > TALL_PX, SHRUNK_PX / height_px).otherwise(1.0)


def speed_factor(measured_ms: Column) -> Column:
    return F.least(F.lit(MOST_FACTOR), F.greatest(F.lit(LEAST_FACTOR), F.coalesce(measured_ms, F.lit(REFERENCE_MS)) / REFERENCE_MS))


def capabilities(spark: SparkSession, available: DataFrame) -> DataFrame:
    """language, script, exact_model_ready, route_ready, basis from the installed `model` names; both registries are fixed and small."""
    have = available.select("model").distinct().withColumn("there", F.lit(True))
    there = F.coalesce("there", F.lit(False))
    generic = spark.createDataFrame(SCRIPT_MODELS, "script string, model string").join(have, "model", "left").groupBy("script").agg(F.every(there).alias("generic"))
    spec = spark.createDataFrame(LANGUAGES, "language string, script string, model string").join(have, "model", "left").withColumn("exact_model_ready", there)
    basis = F.when(F.col("generic"), "generic_script").when(F.col("exact_model_ready"), "exact_language").otherwise("insufficient_fallback")
    return spec.join(F.broadcast(generic), "script").select("language", "script", "exact_model_ready", (F.col("generic") | F.col("exact_model_ready")).alias("route_ready"), basis.alias("basis"))


def settings(options: DataFrame) -> DataFrame:
    """id, scripts (sorted), max_pages, problem: the first option that is not valid, or none."""
    known = F.array(*map(F.lit, ("Latin", "Cyrillic", "Arabic", "Han")))
    s = F.array_distinct(F.filter(F.transform(F.split(F.coalesce("scripts", F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))
    o = options.withColumn("s", s).withColumns({"pages": F.col("max_pages").try_cast("int"), "px": F.col("min_letter_px").try_cast("double")})
    problem = (
        F.when(F.size(F.array_except("s", known)) > 0, "unknown script")
        .when(F.col("max_pages").isNotNull() & (F.coalesce("pages", F.lit(0)) < 1), "max_pages")
        .when(F.col("min_letter_px").isNotNull() & (F.coalesce("px", F.lit(0.0)) <= 0), "min_letter_px")
        .otherwise("none")
    )
    chosen = F.when(F.size("s") == 0, "Cyrillic+Latin").otherwise(F.array_join(F.sort_array("s"), "+"))
    return o.select("id", chosen.alias("scripts"), F.coalesce("pages", F.when(F.col("max_pages").isNull(), 10)).alias("max_pages"), problem.alias("problem"))


# ---------------------------------------------------------------- sinks


def refusals(journal: DataFrame, path: str | None = None) -> DataFrame:
    """Writes the refused rows as JSON, partitioned by code, and reads them back. The reason defaults to the code."""
    path = path or work_path(journal.sparkSession, "refused")
    code = F.coalesce("code", F.lit("(none)"))
    rows = journal.where("outcome = 'refused'").select("file", "time", code.alias("code"), F.coalesce("reason", code).alias("reason"), "message", "details")
    rows.write.mode("overwrite").partitionBy("code").json(path)
    return journal.sparkSession.read.schema("file string, time string, reason string, message string, details string, code string").json(path)


def benchmark_runs(runs: DataFrame, path: str | None = None) -> DataFrame:
    """Writes runs as JSON lines and reads them back."""
    path = path or work_path(runs.sparkSession, "runs")
    runs.write.mode("overwrite").json(path)
    return runs.sparkSession.read.schema(runs.schema).json(path)


def benchmark_summary(runs: DataFrame) -> DataFrame:
    """Per case of the measured phase: runs, fastest, median and slowest milliseconds, failures, errors and retried pages."""
    return runs.where("phase = 'measured'").groupBy("case_id").agg(
        F.count("*").alias("runs"), g.rounded(F.min("total_ms"), 3).alias("fastest_ms"), g.rounded(F.median("total_ms"), 3).alias("median_ms"), g.rounded(F.max("total_ms"), 3).alias("slowest_ms"),
        F.count_if(~F.col("expectation_met")).alias("quality_failures"), F.count("error").alias("errors"), F.coalesce(F.sum("retry_pages"), F.lit(0)).cast("long").alias("retry_pages"),
    )


def log_lines(journal: DataFrame) -> DataFrame:
    """line: one JSON object a delivery - time, outcome, code, reason, stage, page, pages, milliseconds - without file names or messages."""
    at = lambda k: F.get_json_object("details", f"$.{k}")
    return journal.select(
        F.to_json(F.struct("time", "outcome", "code", "reason", at("stage").alias("stage"), at("page_index").alias("page"), "pages", F.round(F.col("seconds") * 1000).cast("long").alias("ms"))).alias("line")
    )


# ---------------------------------------------------------------- gates


def first_failing(pages: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """The kept columns and `reason`, the first gate that a page's measures fail."""
    at = lambda c, default: F.coalesce(F.col(c), F.lit(default))
    letters = at("letters", 1.0)
    reason = (
        F.when(at("structure", 0) > 0, "unreliable_structure")
        .when((at("garbled", 0) >= 2) | (at("lost", 0.0) > 0.1), "text_unreadable")
        .when((letters < 0.8) & (letters > 0), "text_not_read")
        .when(at("regions", 0) > 0, "unrecognized_text")
        .when(at("weak_cells", 0) > 0, "unresolved_table_cells")
        .otherwise("none")
    )
    return pages.select(*(keep or ["page_id"]), reason.alias("reason"))


def _confidence() -> Column:
    return F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))


def lost_tokens(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, page, n lettered words, garbled (signs inside), lost (weak and unlisted)."""
    listed = lex.word_list(lexicon).select(F.col("word").alias("token"), F.lit(True).alias("listed"))
    w = words.where(F.col("text").rlike(r"\p{L}")).select(*PAGE, "text", lex.token(F.col("text")).alias("token"), _confidence().alias("c")).join(listed, "token", "left")
    garbled = F.col("text").rlike(r"\p{L}[%^~|{}<>\\#=+*]+\p{L}")
    return w.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(garbled).alias("garbled"), F.count_if((F.col("c") < 0.5) & F.col("listed").isNull()).alias("lost"))


# ---------------------------------------------------------------- verdicts


def doubled(tokens: DataFrame, known: DataFrame) -> DataFrame:
    """token, doubled: tokens that are a listed word once one of two equal neighbours is left out."""
    i = F.explode(F.sequence(F.lit(2), F.greatest(F.lit(2), F.length("token"))))
    one = tokens.select("token", i.alias("i")).where(lex.at(F.col("token"), F.col("i")) == lex.at(F.col("token"), F.col("i") - 1))
    single = F.concat(F.substring("token", F.lit(1), F.col("i") - 1), F.substring(F.col("token"), F.col("i") + 1, F.length("token")))
    return one.select("token", single.alias("word")).join(known.select("word"), "word", "left_semi").select("token", F.lit(True).alias("doubled")).distinct()


def token_verdict(token: Column, c: Column, known: Column, doubled: Column, near: Column, alternative: Column, dotted: Column, national: Column) -> Column:
    """ok, unverified or error for one token, by the first rule that speaks."""
    n = F.length(token)
    other = F.coalesce(alternative, F.lit(""))
    agreed, disagreed = (other != "") & (other == token), (other != "") & (other != token)
    ok = lambda test: F.when(test, "ok").otherwise("error")
    surname = token.rlike(r"^\p{Lu}") & F.lower(token).rlike(f"(?:{SURNAME})$")
    foreign = F.regexp_replace(token, f"[{ALPHABET}-]", "").rlike(r"\p{L}")
    return (
        F.when(n == 0, "ok")
        .when((token.rlike(r"\p{IsCyrillic}") & token.rlike(r"\p{IsLatin}")) | foreign | disagreed, "error")
        .when((n == 1) & token.rlike(f"[{NEVER_ALONE}]"), "error")
        .when((n == 1) & (F.upper(token) == token) & dotted, ok(agreed))
        .when(n == 1, ok(agreed | (c >= F.when(dotted, 0.8).otherwise(0.9))))
        .when(doubled & ~known, "error")
        .when(agreed, ok(~((n >= 4) & ~known & ~surname & near)))
        .when(n < 3, ok((c >= 0.9) | ((c >= 0.8) & known)))
        .when(known, ok(c >= 0.5))
        .when(c < 0.6, "error")
        .when(token.rlike(r"^\p{Lu}(?:\p{Ll}*|\p{Lu}*)$") & (c >= 0.8), "unverified")
        .when((F.lower(token).rlike("[әғқңөұүһіўҳӣӯҷјəğıöüşçñäňýžʻ]") | national) & (c >= 0.85), "unverified")
        .otherwise("error")
    )


def word_verdicts(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """doc_id, page, n, unverified, errors, error_share: the verdict of a word is that of its worst part."""
    listed = lex.word_list(lexicon)
    w = words.where(F.col("text").isNotNull()).select(*PAGE, "word_no", "text", F.coalesce("alternative", F.lit("")).alias("alternative"), lex.token(F.col("text")).alias("whole"), _confidence().alias("c"))
    national = words.where(F.col("text").rlike(r"\p{L}")).groupBy(*PAGE).agg((F.count_if(F.lower("text").rlike("[әғқңөұүһіўҳӣӯҷјəğıöüşçñäňýžʻ]")) >= F.greatest(F.lit(3), 0.05 * F.count("*"))).alias("national"))
    part = w.withColumn("token", F.explode(F.split("whole", "-")))
    part = part.join(listed.select(F.col("word").alias("token"), F.lit(True).alias("k1")), "token", "left").join(listed.select(F.col("word").alias("whole"), F.lit(True).alias("k2")), "whole", "left").join(national, PAGE, "left")
    t, x, a, c = F.col("token"), F.col("text"), F.col("alternative"), F.col("c")
    known = F.coalesce("k1", "k2", F.lit(False))
    agreed, disagreed = (a != "") & (a == x), (a != "") & (a != x)
    digits = lambda z: F.regexp_replace(z, r"[^\p{Nd}]", "")
    bad = lambda test: F.when(test, 2).otherwise(0)
    rank = (
        F.when(x.rlike(tx.ADDRESS_LIKE), bad(disagreed))
        .when((digits(x) != digits(a)) & (a != ""), 2)
        .when(~x.rlike(r"\p{L}"), bad(~agreed & ((x.rlike(r"\p{Nd}") & (c < 0.7)) | ((c < 0.3) & (F.length(x) > 2)))))
        .when(x.rlike(tx.JUNK) | (t.rlike(r"\p{IsCyrillic}") & t.rlike(r"\p{IsLatin}")) | disagreed, 2)
        .when((F.length(t) == 1) & t.rlike("[ыьъз]"), 2)
        .when(F.length(t) == 1, bad(~(agreed | (c >= 0.9))))
        .when(agreed, 0)
        .when(F.length(t) < 3, bad(~((c >= 0.9) | ((c >= 0.8) & known))))
        .when(known, bad(c < 0.5))
        .when(c < 0.6, 2)
        .when(x.rlike(r"^\P{L}*\p{Lu}") & (c >= 0.8), 1)
        .when((t.rlike("[әғқңөұүһіўҳӣӯҷјəğıöüşçñäňýžʻ]") | F.coalesce("national", F.lit(False))) & (c >= 0.85), 1)
        .otherwise(2)
    )
    worst = part.groupBy(*PAGE, "word_no").agg(F.max(rank).alias("worst"))
    s = worst.groupBy(*PAGE).agg(F.count("*").alias("n"), F.count_if(F.col("worst") == 1).alias("unverified"), F.count_if(F.col("worst") == 2).alias("errors"))
    return s.withColumn("error_share", g.rounded(F.col("errors") / F.greatest(F.lit(1), F.col("n"))))


# ---------------------------------------------------------------- normalisation


def normalised(text: Column, line: Column, national: Column) -> Column:
    """A word with the look-alikes of reading set right; `line` is the alphabet of the other words of its line."""
    t = F.regexp_replace(F.regexp_replace(text, "[ʻ‘’'`]{2,}", "ʻ"), r"(\p{L})[“”](\p{L})", "$1ʻ$2")
    letters = F.length(F.regexp_replace(t, r"[^\p{L}]", ""))
    latin, cyrillic = F.length(F.regexp_replace(t, r"[^\p{IsLatin}]", "")), F.length(F.regexp_replace(t, r"[^\p{IsCyrillic}]", ""))
    in_cyrillic, in_latin = line == "Cyrillic", line == "Latin"
    lone = F.when(national, F.translate(t, *LONE_ANYWHERE)).otherwise(F.translate(t, LONE_ANYWHERE[0] + LONE_RUSSIAN[0], LONE_ANYWHERE[1] + LONE_RUSSIAN[1]))
    return (
        F.when(t.rlike(r"^(?:N[eoº°]|No\.?|N)$"), "№")
        .when(in_cyrillic & t.rlike(r"^\d+r\.?[,;]?$"), F.replace(t, F.lit("r"), F.lit(" г")))
        .when(in_cyrillic & t.rlike(r"^r\.[,;]?$"), F.replace(t, F.lit("r"), F.lit("г")))
        .when(t.rlike(r"^(?:19|20)\d\d\p{L}+\.?[,;:]?$"), F.concat(F.substring(t, 1, 4), F.lit(" "), F.substring(t, F.lit(5), F.length(t))))
        .when(in_cyrillic & t.rlike(r"^[Tt]en\.?:?$"), F.translate(t, "Tten", "Ттел"))
        .when(in_latin & (letters == 1) & (cyrillic == 1), F.translate(t, *LONE_LATIN))
        .when(in_cyrillic & (letters == 1) & (latin == 1), lone)
        .when((latin > 0) & (cyrillic > latin), F.translate(t, LATIN_LIKE, CYRILLIC_LIKE))
        .when((cyrillic > 0) & (latin > cyrillic), F.translate(t, CYRILLIC_LIKE, LATIN_LIKE))
        .otherwise(t)
    )


def junk_lines(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Lines of which half the words are weak and unlisted, in small print or six words long at the edge of the page."""
    listed = lex.word_list(lexicon).select(F.col("word").alias("token"), F.lit(True).alias("listed"))
    w = words.where(F.col("text").isNotNull() & (F.size("line_id") > 0)).select(*PAGE, F.array_join(F.col("line_id").cast("array<string>"), "-").alias("line_key"), "y0", "y1", lex.token(F.col("text")).alias("token"), _confidence().alias("c"))
    k = w.join(listed, "token", "left").withColumns({"doubt": (F.col("c") < 0.8) & F.col("listed").isNull(), "h": F.col("y1") - F.col("y0")})
    body = k.groupBy(*PAGE).agg(F.median("h").alias("body"), F.max("y1").alias("end"))
    l = k.groupBy(*PAGE, "line_key").agg(F.count("*").alias("n"), F.count_if("doubt").alias("doubtful"), F.median("h").alias("h"), F.min("y0").alias("y0"), F.max("y1").alias("y1"))
    small = F.col("h") < 0.8 * F.col("body")
    edge = (F.col("n") >= 6) & ((F.col("y1") < 0.12 * F.col("end")) | (F.col("y0") > 0.85 * F.col("end")))
    return l.join(body, PAGE).where((F.col("doubtful") >= 0.5 * F.col("n")) & (small | edge)).select(*PAGE, "line_key", "n", "doubtful", small.alias("small"))


# ---------------------------------------------------------------- pictures, columns, cells


def outside_pictures(words: DataFrame, pictures: DataFrame) -> DataFrame:
    """Words (page, word_no, line_no, box) but for those whose centre a picture holds, unless two well read words of their line lie outside it."""
    x, y = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    held = words.join(pictures, "page").where(x.between(F.col("px0"), F.col("px1")) & y.between(F.col("py0"), F.col("py1"))).select("page", "word_no").distinct()
    inside = words.join(held.withColumn("inside", F.lit(True)), ["page", "word_no"], "left").withColumn("inside", F.coalesce("inside", F.lit(False)))
    out = F.sum(F.when(~F.col("inside") & (F.col("c") >= 0.75), 1).otherwise(0)).over(Window.partitionBy("page", "line_no"))
    return inside.withColumn("outside", out).where(~F.col("inside") | (F.col("outside") >= 2))


def graphics_between(columns: DataFrame, graphics: DataFrame) -> DataFrame:
    """page, graphic_no, after_col: graphics between two neighbouring columns, with their centre beside the columns' rows."""
    b = columns.select("page", (F.col("col_no") - 1).alias("col_no"), F.col("x0").alias("next_x0"), F.col("y0").alias("next_y0"), F.col("y1").alias("next_y1"))
    pair = columns.join(b, ["page", "col_no"])
    centre = (F.col("gy0") + F.col("gy1")) / 2
    hit = (F.col("gx0") >= F.col("x1")) & (F.col("gx1") <= F.col("next_x0")) & centre.between(F.least("y0", "next_y0") - 4, F.greatest("y1", "next_y1") + 4)
    return graphics.join(pair, "page").where(hit).select("page", "graphic_no", F.col("col_no").alias("after_col"))


def cell_text(words: DataFrame) -> DataFrame:
    """cell_no, n_words, text of the words (cell_no, word_no, line_no, box, text) of cells."""
    line = words.where(F.col("text").isNotNull()).groupBy("cell_no", "line_no").agg(
        F.count("*").alias("n"), F.min("y0").alias("y"), F.min("x0").alias("x"), F.sort_array(F.collect_list(F.struct("x0", "word_no", "text"))).alias("w"), tx.direction(F.array_join(F.collect_list("text"), " ")).alias("direction")
    )  # bounded by a line
    glue = lambda texts: F.aggregate(texts, F.lit(""), lambda acc, t: F.concat(acc, F.when(acc == "", "").otherwise(tx.separator(acc, t)), t))
    texts = F.transform(F.when(F.col("direction") == "rtl", F.reverse("w")).otherwise(F.col("w")), lambda s: s["text"])
    per = line.withColumn("text", glue(texts)).groupBy("cell_no").agg(F.sum("n").alias("n_words"), F.sort_array(F.collect_list(F.struct("y", "x", "text"))).alias("lines"))
    return per.select("cell_no", "n_words", glue(F.transform("lines", lambda s: s["text"])).alias("text"))


def model_issues(pages: DataFrame, blocks: DataFrame) -> DataFrame:
    """code, doc, page, item of every violated rule of pages (doc, page, idx, w, h) and blocks (doc, page, item, kind, box, source, bytes)."""
    issue = lambda df, code, item: df.select(F.lit(code).alias("code"), "doc", "page", item.alias("item"))
    none, item = F.lit(-1), F.col("item")
    outside = (F.col("x0") < -2) | (F.col("y0") < -2) | (F.col("x1") > F.col("w") + 2) | (F.col("y1") > F.col("h") + 2)
    out = issue(pages.groupBy("doc", "idx").agg(F.min("page").alias("page"), F.count("*").alias("n")).where("n > 1"), "duplicate_page_index", none)
    for df, code, i in (
        (pages.where("w <= 0 or h <= 0 or w > 20000 or h > 20000"), "page_geometry", none),
        (blocks.where("x1 <= x0 or y1 <= y0"), "block_geometry", item),
        (blocks.join(pages.select("doc", "page", "w", "h"), ["doc", "page"]).where(outside), "outside_page", item),
        (blocks.where("source <> page"), "provenance", item),
        (blocks.where("kind = 'graphic' and coalesce(bytes, 0) = 0"), "empty_graphic", item),
    ):
        out = out.unionByName(issue(df, code, i))
    return out


def _merged(spans: list[tuple[float, float]]) -> list[list[float]]:
    out: list[list[float]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1] + 4.0:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return out


def _bands_of(rows: list[tuple[int, list[tuple[float, float, float, float]]]]) -> list[tuple[int, int, int, int]]:
    """band_no, first and last row, slots, of rows (row_no, boxes) from the top."""
    width = max((b[2] for _, r in rows for b in r), default=0.0) - min((b[0] for _, r in rows for b in r), default=0.0)
    out: list[tuple[int, int, int, int]] = []
    band: list[int] = []

    def slots(members: list[int]) -> list[list[float]]:
        return _merged([(b[0], b[2]) for k in members for b in rows[k][1]])

    def close() -> None:
        if band:
            out.append((len(out) + 1, rows[band[0]][0], rows[band[-1]][0], len(slots(band))))
            band.clear()

    for i, (_, boxes) in enumerate(rows):
        if band:
            above = rows[band[-1]][1]
            tall = max(max(b[3] for b in r) - min(b[1] for b in r) for r in (above, boxes))
            own = slots(band)
            hits = [[k for k, (a, b) in enumerate(own) if min(b, x[2]) - max(a, x[0]) > 0] for x in boxes]
            fits = all(len(h) == 1 for h in hits) and len({h[0] for h in hits}) == len(hits) and (len(boxes) > 1 or boxes[0][2] - boxes[0][0] < 0.6 * width)
            if min(b[1] for b in boxes) - max(b[3] for b in above) <= 1.8 * tall and (fits if len(own) > 1 else len(boxes) > 1):
                band.append(i)
                continue
            close()
        if len(boxes) > 1:
            band.append(i)
    close()
    return out


def bands(segments: DataFrame) -> DataFrame:
    """page, band_no, first_row, last_row, n_slots of the segments (page, row_no, segment_no, box) of a page."""

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = [(int(k), [tuple(b) for b in r.sort_values("x0")[["x0", "y0", "x1", "y1"]].itertuples(index=False)]) for k, r in pdf.groupby("row_no")]
        return pd.DataFrame([(int(pdf["page"].iloc[0]), *b) for b in _bands_of(rows)], columns=["page", "band_no", "first_row", "last_row", "n_slots"])

    return segments.groupBy("page").applyInPandas(one, "page int, band_no int, first_row int, last_row int, n_slots int")


def digit_anomalies(text: Column, centres: Column) -> Column:
    """Runs of Arabic-Indic digits, in texts with Arabic letters, of at least two different digits whose centres run right to left."""
    place = F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(text))), lambda i: F.struct(F.substring(text, i, F.lit(1)).alias("c"), F.element_at(centres, i).alias("x")))
    empty = F.struct(F.lit("").alias("run"), F.lit(None).cast("double").alias("last"), F.lit(True).alias("back"), F.lit(0).alias("n"))
    done = lambda s: s["n"] + F.when((F.length(s["run"]) > 1) & s["back"] & (F.size(F.array_distinct(F.split(s["run"], ""))) > 1), 1).otherwise(0)

    def step(s, p):
        digit = p["c"].rlike("[٠-٩۰-۹]")
        return F.struct(
            F.when(digit, F.concat(s["run"], p["c"])).otherwise("").alias("run"), F.when(digit, p["x"]).alias("last"), F.when(digit, s["back"] & (s["last"].isNull() | (p["x"] < s["last"]))).otherwise(True).alias("back"), F.when(digit, s["n"]).otherwise(done(s)).alias("n")
        )

    return F.when(text.rlike("[ء-ي]"), F.aggregate(place, empty, step, done)).otherwise(0)


def trimmed_runs(runs: DataFrame, prefix: DataFrame, keys: list[str]) -> DataFrame:
    """Runs (keys, run_no, text, ...) without the first `n_prefix` characters of their block; a run that ends inside the prefix goes,
    the one it ends in keeps its style and the rest of its text. Blocks without a prefix keep all; null texts count as empty."""
    order = Window.partitionBy(*keys).orderBy("run_no").rowsBetween(Window.unboundedPreceding, 0)
    r = runs.withColumn("text", F.coalesce("text", F.lit(""))).join(prefix.select(*keys, "n_prefix"), keys, "left")
    end = F.sum(F.length("text")).over(order)
    left = F.coalesce("n_prefix", F.lit(0)) - (F.col("__end") - F.length("text"))
    r = r.withColumn("__end", end).withColumn("__left", F.greatest(left, F.lit(0)).cast("int"))
    return r.withColumn("text", F.substring(F.col("text"), F.col("__left") + 1, F.length("text"))).where(F.length("text") > 0).drop("__end", "__left", "n_prefix")


def split_spans(cells: DataFrame, spans: DataFrame) -> DataFrame:
    """table_id, span_no: spans of running text that two cells of one row cut, so that the cells are no table. A cell counts with a quarter of
    its height (at most 2) and an eighth of its width (at most 5) inside the span."""
    w = F.least("x1", "sx1") - F.greatest("x0", "sx0")
    h = F.least("y1", "sy1") - F.greatest("y0", "sy0")
    hit = (h >= F.least(F.lit(2.0), (F.col("y1") - F.col("y0")) * 0.25)) & (w >= F.least(F.lit(5.0), (F.col("x1") - F.col("x0")) * 0.12))
    cut = cells.join(spans, "table_id").where(hit).groupBy("table_id", "row_no", "span_no").agg(F.count("*").alias("n")).where("n >= 2")
    return cut.select("table_id", "span_no").distinct()
