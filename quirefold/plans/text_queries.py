"""Queries over text functions, scripts, tokens, corrections, routes, costs and checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions import geometry as g
from quirefold.functions import text as tx
from quirefold.operators import lexical as lex
from quirefold.operators import routing as rt
from quirefold.plans.made import WORDS_TOO, words_too
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


R = lambda x, k=10000: f"floor(({x}) * {k}.0 + 0.5) / {k}.0"
CNT = lambda t, c: f"length(regexp_replace({t}, '[^{c}]', '', 'g'))"
TOK = "regexp_replace(lower(replace(text, 'İ', 'i')), '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g')"
TOKENS = f"tokens AS (SELECT {TOK} AS token, count(*) AS n FROM words WHERE text IS NOT NULL GROUP BY 1 HAVING token <> '')"
LIST = "list AS (SELECT DISTINCT lower(word) AS word FROM lexicon WHERE word IS NOT NULL)"
# Letters of Kazakh, Kyrgyz, Uzbek, Tajik and Azerbaijani, Uzbek, Turkmen that Russian and English lack.
NATIONAL = "әғқңөұүһіўҳӣӯҷјəğıöüşçñäňýžʻ"
PLAN = "plan AS (SELECT DISTINCT * FROM page_plan)"


@query(
    "text_p5_bad_characters",
    f"""WITH t AS (SELECT doc_id, page, string_agg(text, ' ' ORDER BY word_no) AS text FROM words WHERE text IS NOT NULL GROUP BY ALL)
      SELECT doc_id, page, {CNT("text", "\\p{Cc}\\x{FFFD}")} AS n_bad, {CNT("text", "\\p{L}\\p{N}")} AS n_useful,
      {R(CNT("text", "\\p{Cc}\\x{FFFD}") + " / greatest(1, length(replace(text, ' ', '')))")} AS ratio FROM t""",
)
def text_p5_bad_characters(spark, d):
    """Control and replacement characters and useful characters per page; counts add up per word."""
    w = table(spark, d, "words").where("text is not null")
    bad, solid = F.sum(tx.count_of(F.col("text"), r"[\p{Cc}\x{FFFD}]")), F.sum(F.length(F.replace("text", F.lit(" "), F.lit(""))))
    s = w.groupBy(*PAGE).agg(bad.alias("n_bad"), F.sum(tx.count_of(F.col("text"), r"[\p{L}\p{N}]")).alias("n_useful"), solid.alias("solid"))
    return s.select(*PAGE, "n_bad", "n_useful", g.rounded(F.col("n_bad") / F.greatest(F.lit(1), "solid")).alias("ratio"))


@query(
    "pred_p10_token_predicates",
    """SELECT doc_id, page, count(*) FILTER (regexp_matches(text, '[%^~|{}<>\\\\#=+*]') OR regexp_matches(text, '(^|[^0-9A-Za-zА-Яа-яЁё])_|_([^0-9A-Za-zА-Яа-яЁё]|$)')) AS n_junk,
      count(*) FILTER (regexp_matches(text, '(?i)@|https?:|www\\.|\\.(ru|kz|uz|kg|tj|tm|az|com|org|net|gov)([^\\p{L}\\p{N}_]|$)')) AS n_address,
      count(*) FILTER (regexp_matches(text, '^\\p{Lu}\\.$')) AS n_initials, count(*) FILTER (regexp_matches(text, '[^\\p{L}\\p{N}\\p{P}\\s]') AND regexp_matches(text, '[\\p{L}\\p{N}]')) AS n_garbled,
      count(*) FILTER (regexp_matches(text, '^[\\d.,/-]*\\d[\\d.,/-]*$')) AS n_numbers FROM words WHERE text IS NOT NULL GROUP BY ALL""",
)
def pred_p10_token_predicates(spark, d):
    t = F.col("text")
    return table(spark, d, "words").where("text is not null").groupBy(*PAGE).agg(
        F.count_if(t.rlike(tx.JUNK) | t.rlike(tx.LOOSE_UNDERSCORE)).alias("n_junk"),
        F.count_if(t.rlike(tx.ADDRESS_LIKE) | t.rlike(tx.DOMAIN)).alias("n_address"),
        F.count_if(t.rlike(r"^\p{Lu}\.$")).alias("n_initials"),
        F.count_if(t.rlike(r"[^\p{L}\p{N}\p{P}\s]") & t.rlike(r"[\p{L}\p{N}]")).alias("n_garbled"),
        F.count_if(t.rlike(r"^[\d.,/-]*\d[\d.,/-]*$")).alias("n_numbers"),
    )


_LET = {"latin": "\\p{Latin}", "cyrillic": "\\p{Cyrillic}", "arabic": "\\p{Arabic}", "han": "\\p{Han}"}


@query(
    "script_g9_histogram",
    f"""WITH c AS (SELECT doc_id, {", ".join(f"{CNT('text', v)} AS {k}" for k, v in _LET.items())} FROM documents WHERE text IS NOT NULL)
      SELECT *, CASE WHEN latin + cyrillic + arabic + han < 3 THEN NULL WHEN latin >= cyrillic AND latin >= arabic AND latin >= han THEN 'Latin'
      WHEN cyrillic >= arabic AND cyrillic >= han THEN 'Cyrillic' WHEN arabic >= han THEN 'Arabic' ELSE 'Han' END AS dominant FROM c""",
)
def script_g9_histogram(spark, d):
    """Characters of each script and the dominant one; ties go to the script named first."""
    c = table(spark, d, "documents").where("text is not null").select("doc_id", *[tx.count_of(F.col("text"), tx.SCRIPTS[k]).alias(k.lower()) for k in tx.SCRIPTS])
    la, cy, ar, ha = (F.col(k) for k in ("latin", "cyrillic", "arabic", "han"))
    top = F.when(la + cy + ar + ha < 3, None).when((la >= cy) & (la >= ar) & (la >= ha), "Latin").when((cy >= ar) & (cy >= ha), "Cyrillic").when(ar >= ha, "Arabic").otherwise("Han")
    return c.withColumn("dominant", top)


@query(
    "script_p14_gate",
    f"""WITH c AS (SELECT doc_id, {CNT("text", "\\p{Arabic}")} + {CNT("text", "\\p{Han}")} AS n_foreign, {" + ".join(CNT("text", v) for v in _LET.values())} AS n_letters FROM documents WHERE text IS NOT NULL)
      SELECT doc_id, n_foreign, n_letters FROM c WHERE n_foreign >= 10 OR (n_foreign >= 3 AND n_foreign >= 0.01 * n_letters)""",
)
def script_p14_gate(spark, d):
    """Documents with letters of scripts beyond Latin and Cyrillic, ten or a share of one in a hundred."""
    t = F.col("text")
    foreign = tx.count_of(t, tx.SCRIPTS["Arabic"]) + tx.count_of(t, tx.SCRIPTS["Han"])
    allc = foreign + tx.count_of(t, tx.SCRIPTS["Latin"]) + tx.count_of(t, tx.SCRIPTS["Cyrillic"])
    c = table(spark, d, "documents").where("text is not null").select("doc_id", foreign.alias("n_foreign"), allc.alias("n_letters"))
    return c.where("n_foreign >= 10 or (n_foreign >= 3 and n_foreign >= 0.01 * n_letters)")


@query(
    "script_f12_direction",
    "SELECT doc_id, page, block_no, CASE WHEN length(regexp_replace(regexp_replace(text, '[^\\p{Arabic}\\p{Hebrew}]', '', 'g'), '[^\\p{L}]', '', 'g')) * 2 > length(regexp_replace(text, '[^\\p{L}]', '', 'g')) THEN 'rtl' ELSE 'ltr' END AS direction FROM blocks WHERE text IS NOT NULL",
)
def script_f12_direction(spark, d):
    return table(spark, d, "blocks").where("text is not null").select(*PAGE, "block_no", tx.direction(F.col("text")).alias("direction"))


@query(
    "script_f29_profiles",
    f"""WITH c AS (SELECT doc_id, page, {", ".join(f"sum({CNT('text', v)}) AS {k}" for k, v in _LET.items())} FROM words WHERE text IS NOT NULL GROUP BY ALL)
      SELECT doc_id, page, concat_ws('+', CASE WHEN arabic >= 3 THEN 'Arabic' END, CASE WHEN cyrillic >= 3 THEN 'Cyrillic' END, CASE WHEN han >= 3 THEN 'Han' END, CASE WHEN latin >= 3 THEN 'Latin' END) AS profile FROM c""",
)
def script_f29_profiles(spark, d):
    """The scripts with at least three characters on a page, as one profile."""
    w = table(spark, d, "words").where("text is not null")
    c = w.groupBy(*PAGE).agg(*[F.sum(tx.count_of(F.col("text"), tx.SCRIPTS[k])).alias(k) for k in tx.SCRIPTS])
    return c.select(*PAGE, F.concat_ws("+", *[F.when(F.col(k) >= 3, F.lit(k)) for k in sorted(tx.SCRIPTS)]).alias("profile"))


@query("text_f4_collapsed", "SELECT doc_id, length(text)::INT AS n_before, length(trim(regexp_replace(text, '[\\s\\x{00A0}\\x{2007}\\x{202F}]+', ' ', 'g')))::INT AS n_after FROM documents WHERE text IS NOT NULL")
def text_f4_collapsed(spark, d):
    t = F.col("text")
    return table(spark, d, "documents").where("text is not null").select("doc_id", F.length(t).alias("n_before"), F.length(tx.collapsed(t)).alias("n_after"))


def edit_distance(e: str, a: str) -> str:
    """The edit distance of two texts in characters (the check engine's own counts bytes): one row of the table per
    character of the first, folded over the characters of the second."""
    step = "least(acc[j[1]] + 1, r[j[1] + 1] + 1, r[j[1]] + CASE WHEN unicode(substr({a}, j[1], 1)) = x[1] THEN 0 ELSE 1 END)".format(a=a)
    row = f"list_reduce(list_transform(range(1, length({a}) + 1), lambda k: [k::INTEGER]), lambda acc, j: list_append(acc, {step}), [r[1] + 1])"
    return f"""CASE WHEN {e} = '' THEN length({a}) ELSE list_reduce(list_transform(range(1, length({e}) + 1), lambda k: [unicode(substr({e}, k, 1))]), lambda r, x: {row}, range(0, length({a}) + 1)::INTEGER[])[length({a}) + 1] END"""


@query(
    "text_f8_error_rates",
    f"""WITH p AS (SELECT doc_id, page, word_no, lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS e, lower(regexp_replace(alternative, '[^\\p{{L}}\\p{{N}}]', '', 'g')) AS a FROM words WHERE alternative IS NOT NULL)
      SELECT doc_id, page, word_no, {R(f"({edit_distance('e', 'a')}) / greatest(1, length(e))")} AS rate FROM p""",
)
def text_f8_error_rates(spark, d):
    """Edits per character between a word and its second reading, in every script. A word without text has no rate."""
    w = table(spark, d, "words").where(F.col("alternative").isNotNull())
    return w.select(*PAGE, "word_no", g.rounded(tx.error_rate(F.col("text"), F.col("alternative"))).alias("rate"))


@query("text_f14_token_core", "SELECT doc_id, page, word_no, regexp_extract(text, '^([^\\p{L}\\p{N}]*)', 1) AS lead, regexp_replace(text, '^[^\\p{L}\\p{N}]+|[^\\p{L}\\p{N}]+$', '', 'g') AS core, regexp_replace(text, '[^\\p{Nd}]', '', 'g') AS digits FROM words WHERE text IS NOT NULL")
def text_f14_token_core(spark, d):
    t = F.col("text")
    return table(spark, d, "words").where("text is not null").select(
        *PAGE, "word_no", F.regexp_extract(t, r"^([^\p{L}\p{N}]*)", 1).alias("lead"), F.regexp_replace(t, r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "").alias("core"), F.regexp_replace(t, r"[^\p{Nd}]", "").alias("digits")
    )


@query(
    "text_f16_lookalike_moves",
    """SELECT doc_id, page, word_no, translate(text, 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху') AS moved FROM words
      WHERE regexp_matches(text, '\\p{Cyrillic}') AND regexp_matches(text, '\\p{Latin}') AND NOT regexp_matches(translate(text, 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху'), '\\p{Latin}')""",
)
def text_f16_lookalike_moves(spark, d):
    """Mixed words whose every Latin letter looks like a Cyrillic one, in Cyrillic."""
    moved = F.translate("text", "ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху")
    return table(spark, d, "words").where(F.col("text").rlike(r"\p{IsCyrillic}") & F.col("text").rlike(r"\p{IsLatin}") & ~moved.rlike(r"\p{IsLatin}")).select(*PAGE, "word_no", moved.alias("moved"))


@query("text_f20_years", "SELECT doc_id, page, word_no, regexp_extract(text, '((19|20)\\d{2})', 1) AS year, regexp_extract(text, '(19|20)\\d{2}(\\P{Nd}*)$', 2) AS suffix FROM words WHERE regexp_matches(text, '(^|\\P{Nd})(19|20)\\d{2}\\P{Nd}*$')")
def text_f20_years(spark, d):
    w = table(spark, d, "words").where(F.col("text").rlike(r"(^|\P{Nd})(19|20)\d{2}\P{Nd}*$"))
    return w.select(*PAGE, "word_no", F.regexp_extract("text", r"((19|20)\d{2})", 1).alias("year"), F.regexp_extract("text", r"(19|20)\d{2}(\P{Nd}*)$", 2).alias("suffix"))


@query(
    "text_f22_stray_brackets",
    f"""WITH {WORDS_TOO}, l AS (SELECT doc_id, page, line_id, string_agg(text, ' ' ORDER BY word_no) AS t FROM words_too WHERE text IS NOT NULL GROUP BY ALL)
      SELECT doc_id, page, array_to_string(line_id, '-') AS line_key, (length(t) - length(replace(t, '(', '')))::INT AS opened, (length(t) - length(replace(t, ')', '')))::INT AS closed FROM l
      WHERE length(replace(t, '(', '')) <> length(replace(t, ')', ''))""",
)
def text_f22_stray_brackets(spark, d):
    l = words_too(spark, d).where("text is not null").groupBy(*PAGE, "line_id").agg(
        F.sum(tx.count_of(F.col("text"), r"\(")).cast("int").alias("opened"), F.sum(tx.count_of(F.col("text"), r"\)")).cast("int").alias("closed")
    )
    return l.where("opened <> closed").select(*PAGE, F.array_join(F.col("line_id").cast("array<string>"), "-").alias("line_key"), "opened", "closed")


@query("lex_l1_known_tokens", f"""WITH {TOKENS}, {LIST}, p AS (SELECT token, unnest(string_split(token, '-')) AS part FROM tokens), q AS (SELECT token, bool_and(part IN (SELECT word FROM list)) AS ok FROM p GROUP BY token)
      SELECT token, n, token IN (SELECT word FROM list) OR (contains(token, '-') AND ok) AS known FROM tokens JOIN q USING (token)""")
def lex_l1_known_tokens(spark, d):
    return lex.known(lex.token_counts(table(spark, d, "words")), lex.word_list(table(spark, d, "lexicon"))).select("token", "n", "known")


_CUT = "list_distinct(list_append(list_transform(range(1, length({0}) + 1), lambda k: substr({0}, 1, k - 1) || substr({0}, k + 1)), {0}))"
_ALIKE = ", ".join(f"'{x}'" for p in lex.LOOKALIKE_PAIRS for x in (p, p[::-1]))


@query(
    "lex_l5_corrections",
    f"""WITH {TOKENS}, {LIST}, p AS (SELECT token, unnest(string_split(token, '-')) AS part FROM tokens), q AS (SELECT token, bool_and(part IN (SELECT word FROM list)) AS ok FROM p GROUP BY token),
      u AS (SELECT token FROM tokens JOIN q USING (token) WHERE token NOT IN (SELECT word FROM list) AND NOT (contains(token, '-') AND ok) AND length(token) BETWEEN 2 AND (SELECT max(length(word)) + 1 FROM list)),
      f AS (SELECT token, unnest({_CUT.format("token")}) AS form FROM u), w AS (SELECT word, unnest({_CUT.format("word")}) AS form FROM list WHERE length(word) >= 2),
      c AS (SELECT DISTINCT token, word FROM f JOIN w USING (form)),
      e AS (SELECT token, word, length(token) - length(word) AS longer, list_filter(range(1, length(token) + 1), lambda k: substr(token, k, 1) <> substr(word, k, 1)) AS spots FROM c),
      r AS (SELECT token, word, CASE WHEN longer = 1 THEN 1 WHEN longer = -1 THEN 2 WHEN len(spots) = 2 THEN 1
          WHEN substr(token, spots[1], 1) || substr(word, spots[1], 1) IN ({_ALIKE}) THEN 0 ELSE 2 END AS cost FROM e
        WHERE longer = 1 AND list_contains({_CUT.format("token")}, word) OR longer = -1 AND list_contains({_CUT.format("word")}, token) OR longer = 0 AND len(spots) = 1
          OR longer = 0 AND len(spots) = 2 AND spots[2] = spots[1] + 1 AND substr(token, spots[1], 1) = substr(word, spots[2], 1) AND substr(token, spots[2], 1) = substr(word, spots[1], 1))
      SELECT token, word, cost, place::INT AS place FROM (SELECT *, row_number() OVER (PARTITION BY token ORDER BY cost, word) AS place FROM r) WHERE place <= 12""",
)
def lex_l5_corrections(spark, d):
    """Ranked corrections of unknown tokens."""
    words = lex.word_list(table(spark, d, "lexicon"))
    t = lex.known(lex.token_counts(table(spark, d, "words")), words).where("not known")
    return lex.corrections(t.select("token"), words).select("token", "word", "cost", "place")


@query(
    "lex_l7_votes",
    """WITH v AS (SELECT doc_id, page, word_no, text, alternative, regexp_replace(replace(translate(translate(text, '’‘ʼ`''—–‐‑', 'ʻʻʻʻʻ----'), 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху'), ' ', ''), '^[|\\[\\]{}_]+|[|\\[\\]{}_]+$', '', 'g') AS a,
        regexp_replace(replace(translate(translate(alternative, '’‘ʼ`''—–‐‑', 'ʻʻʻʻʻ----'), 'ABCEHKMOPTXYaceopxy', 'АВСЕНКМОРТХУасеорху'), ' ', ''), '^[|\\[\\]{}_]+|[|\\[\\]{}_]+$', '', 'g') AS b FROM words)
      SELECT doc_id, page, count(*) FILTER (alternative <> '' AND a = b) AS agree, count(*) FILTER (alternative <> '' AND a <> b) AS disagree, count(*) FILTER (alternative = '') AS nothing_there,
      count(*) FILTER (alternative <> '' AND regexp_replace(text, '[^\\p{Nd}]', '', 'g') <> regexp_replace(alternative, '[^\\p{Nd}]', '', 'g')) AS digits_differ FROM v GROUP BY ALL""",
)
def lex_l7_votes(spark, d):
    t, a = F.col("text"), F.col("alternative")
    same = tx.vote_form(t) == tx.vote_form(a)
    digits = lambda c: F.regexp_replace(c, r"[^\p{Nd}]", "")
    return table(spark, d, "words").groupBy(*PAGE).agg(
        F.count_if((a != "") & same).alias("agree"), F.count_if((a != "") & ~same).alias("disagree"), F.count_if(a == "").alias("nothing_there"), F.count_if((a != "") & (digits(t) != digits(a))).alias("digits_differ")
    )


@query(
    "lex_l8_verdicts",
    f"""WITH {LIST}, t AS (SELECT doc_id, page, word_no, {TOK} AS token, coalesce(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END, 0) AS c, text, alternative FROM words WHERE text IS NOT NULL),
      v AS (SELECT *, CASE WHEN regexp_matches(token, '\\p{{Cyrillic}}') AND regexp_matches(token, '\\p{{Latin}}') THEN 'error'
        WHEN NOT regexp_matches(token, '\\p{{L}}') THEN CASE WHEN c < 0.7 AND regexp_matches(token, '\\p{{Nd}}') THEN 'error' ELSE 'ok' END
        WHEN regexp_matches(text, '[%^~|{{}}<>\\\\#=+*]') THEN 'error' WHEN alternative = text THEN 'ok' WHEN length(token) = 1 THEN CASE WHEN c >= 0.9 THEN 'ok' ELSE 'error' END
        WHEN token IN (SELECT word FROM list) THEN CASE WHEN c >= 0.5 THEN 'ok' ELSE 'error' END WHEN c < 0.6 THEN 'error'
        WHEN regexp_matches(text, '^\\P{{L}}*\\p{{Lu}}') AND c >= 0.8 THEN 'unverified' ELSE 'error' END AS verdict FROM t)
      SELECT doc_id, page, verdict, count(*) AS n FROM v GROUP BY ALL""",
)
def lex_l8_verdicts(spark, d):
    """Token verdicts by ordered rules: mixed scripts, numbers, junk, agreement, single letters, the word list, confidence, names."""
    listed = lex.word_list(table(spark, d, "lexicon")).select(F.col("word").alias("token"), F.lit(True).alias("listed"))
    w = table(spark, d, "words").where("text is not null").withColumns({"token": lex.token(F.col("text")), "c": F.coalesce(F.nanvl("confidence", F.lit(0.0)), F.lit(0.0))})
    t, x, c = F.col("token"), F.col("text"), F.col("c")
    verdict = (
        F.when(t.rlike(r"\p{IsCyrillic}") & t.rlike(r"\p{IsLatin}"), "error")
        .when(~t.rlike(r"\p{L}"), F.when((c < 0.7) & t.rlike(r"\p{Nd}"), "error").otherwise("ok"))
        .when(x.rlike(tx.JUNK), "error")
        .when(F.col("alternative") == x, "ok")
        .when(F.length(t) == 1, F.when(c >= 0.9, "ok").otherwise("error"))
        .when(F.col("listed"), F.when(c >= 0.5, "ok").otherwise("error"))
        .when(c < 0.6, "error")
        .when(x.rlike(r"^\P{L}*\p{Lu}") & (c >= 0.8), "unverified")
        .otherwise("error")
    )
    return w.join(listed, "token", "left").groupBy(*PAGE, verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(
    "agg_g13_page_languages",
    f"""WITH t AS (SELECT doc_id, page, {TOK} AS token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY word_no) AS k FROM words WHERE text IS NOT NULL) WHERE k <= 200),
      l AS (SELECT DISTINCT lang, lower(word) AS word FROM lexicon WHERE word IS NOT NULL), c AS (SELECT doc_id, page, lang, count(*) AS n FROM t JOIN l ON token = word WHERE length(token) >= 4 GROUP BY ALL)
      SELECT doc_id, page, lang, n FROM (SELECT *, max(n) OVER (PARTITION BY doc_id, page) AS top FROM c) WHERE n >= 0.8 * top""",
)
def agg_g13_page_languages(spark, d):
    """Languages whose list holds nearly as many of a page's first 200 words as the best one's."""
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_no"))
    t = table(spark, d, "words").where("text is not null").withColumn("k", k).where("k <= 200").select(*PAGE, lex.token(F.col("text")).alias("token")).where("length(token) >= 4")
    l = table(spark, d, "lexicon").where("word is not null").select("lang", F.lower("word").alias("token")).distinct()
    c = t.join(l, "token").groupBy(*PAGE, "lang").agg(F.count("*").alias("n"))
    return c.withColumn("top", F.max("n").over(Window.partitionBy(*PAGE))).where("n >= 0.8 * top").drop("top")


@query(
    "agg_g14_coverage",
    f"""WITH {LIST}, t AS (SELECT doc_id, page, {TOK} AS token FROM (SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY word_no) AS k FROM words WHERE regexp_matches(text, '\\p{{L}}')) WHERE k <= 200)
      SELECT doc_id, page, count(*) AS n_long, {R("avg(CASE WHEN token IN (SELECT word FROM list) THEN 1.0 ELSE 0.0 END)")} AS coverage FROM t WHERE length(token) >= 4 GROUP BY ALL""",
)
def agg_g14_coverage(spark, d):
    """The share of long tokens among a page's first 200 lettered words that the list holds."""
    listed = lex.word_list(table(spark, d, "lexicon")).select(F.col("word").alias("token"), F.lit(1.0).alias("hit"))
    k = F.row_number().over(Window.partitionBy(*PAGE).orderBy("word_no"))
    first = table(spark, d, "words").where(F.col("text").rlike(r"\p{L}")).withColumn("k", k).where("k <= 200")
    t = first.select(*PAGE, lex.token(F.col("text")).alias("token")).where("length(token) >= 4")
    return t.join(listed, "token", "left").groupBy(*PAGE).agg(F.count("*").alias("n_long"), g.rounded(F.avg(F.coalesce("hit", F.lit(0.0)))).alias("coverage"))


@query(
    "agg_g15_national_pages",
    f"SELECT doc_id, page, count(*) FILTER (regexp_matches(lower(text), '[{NATIONAL}]')) AS n FROM words WHERE regexp_matches(text, '\\p{{L}}') GROUP BY ALL HAVING n >= greatest(3, 0.05 * count(*))",
)
def agg_g15_national_pages(spark, d):
    """Pages with enough words that hold a letter of the region's languages that Russian and English lack."""
    n = F.count_if(F.lower("text").rlike(f"[{NATIONAL}]"))
    s = table(spark, d, "words").where(F.col("text").rlike(r"\p{L}")).groupBy(*PAGE).agg(n.alias("n"), F.count("*").alias("all"))
    return s.where(F.col("n") >= F.greatest(F.lit(3), 0.05 * F.col("all"))).select(*PAGE, "n")


@query(
    "agg_g17_page_vocabulary",
    f"SELECT doc_id, page, token, count(*) AS n FROM (SELECT doc_id, page, {TOK} AS token FROM words WHERE text IS NOT NULL AND confidence >= 0.8 AND NOT isnan(confidence)) WHERE length(token) >= 3 AND NOT regexp_matches(token, '\\p{{Nd}}') GROUP BY doc_id, page, token",
)
def agg_g17_page_vocabulary(spark, d):
    w = table(spark, d, "words").where("text is not null and confidence >= 0.8 and not isnan(confidence)")
    return w.groupBy(*PAGE, lex.token(F.col("text")).alias("token")).agg(F.count("*").alias("n")).where(~F.col("token").rlike(r"\p{Nd}") & (F.length("token") >= 3))


_TRUST = """valid AS (SELECT w.doc_id, w.page, avg(CASE WHEN x1 > x0 AND y1 > y0 AND x0 >= -2 AND y0 >= -2 AND x1 <= width + 2 AND y1 <= height + 2 AND y1 - y0 <= greatest(144.0, height * 0.25)
    AND x1 - x0 <= greatest(288.0, width * 0.8) THEN 1.0 ELSE 0.0 END) AS valid, count(*) AS n_words,
    1 - count(DISTINCT (lower(replace(text, 'İ', 'i')), floor(x0 * 10 + 0.5), floor(y0 * 10 + 0.5), floor(x1 * 10 + 0.5), floor(y1 * 10 + 0.5))) / count(*) AS duplicates
    FROM words w JOIN (SELECT DISTINCT doc_id, page, width, height FROM page_plan) p ON w.doc_id = p.doc_id AND w.page = p.page WHERE text IS NOT NULL GROUP BY ALL)"""


def _geometry(spark, d):
    p = table(spark, d, "page_plan").select(*PAGE, "width", "height").distinct()
    w = table(spark, d, "words").where("text is not null").join(p, PAGE)
    ten = lambda c: F.floor(F.col(c) * 10 + 0.5)
    sig = F.struct(F.lower(F.replace("text", F.lit("İ"), F.lit("i"))).alias("t"), ten("x0").alias("a"), ten("y0").alias("b"), ten("x1").alias("c"), ten("y1").alias("d"))
    return w.groupBy(*PAGE).agg(
        F.avg(F.when(g.plausible_word(F.col("width"), F.col("height")), 1.0).otherwise(0.0)).alias("valid"), F.count("*").alias("n_words"), (1 - F.count_distinct(sig) / F.count("*")).alias("duplicates")
    )


@query("trust_p4_geometry", f"WITH {_TRUST} SELECT doc_id, page, n_words, {R('valid')} AS valid, {R('duplicates')} AS duplicates FROM valid")
def trust_p4_geometry(spark, d):
    return _geometry(spark, d).select(*PAGE, "n_words", g.rounded(F.col("valid")).alias("valid"), g.rounded(F.col("duplicates")).alias("duplicates"))


@query(
    "trust_g11_layers",
    f"""WITH {_TRUST}, {PLAN}, c AS (SELECT v.doc_id, v.page, n_words, valid, text_layer_status AS given, text_layer_bad_character_ratio AS bad, text_layer_duplicate_ratio AS dup, text_layer_ink_coverage AS ink,
        least(0.95, 0.2 * greatest(0.0, 1 - text_layer_bad_character_ratio * 20) + 0.2 * greatest(0.0, 1 - text_layer_duplicate_ratio * 10) + 0.2 * valid + 0.3 * least(1.0, text_layer_ink_coverage / 0.75) + CASE WHEN ocr_layer_evidence THEN 0.1 ELSE 0.0 END) AS c
        FROM valid v JOIN plan p ON v.doc_id = p.doc_id AND v.page = p.page WHERE text_layer_status IN ('TRUSTED', 'UNTRUSTED'))
      SELECT doc_id, page, given, {R("c")} AS confidence, n_words >= 3 AND bad <= 0.02 AND dup <= 0.05 AND valid >= 0.98 AND ink >= 0.65 AND c >= 0.7 AS trusted FROM c""",
)
def trust_g11_layers(spark, d):
    """Trust of text layers from their measures and the geometry of their words."""
    p = table(spark, d, "page_plan").distinct().where("text_layer_status in ('TRUSTED', 'UNTRUSTED')")
    bad, dup, ink = (F.col(f"text_layer_{k}") for k in ("bad_character_ratio", "duplicate_ratio", "ink_coverage"))
    j = _geometry(spark, d).join(p, PAGE).withColumn("c", rt.layer_confidence(bad, dup, F.col("valid"), ink, F.when(F.col("ocr_layer_evidence"), 1.0).otherwise(0.0)))
    ok = (F.col("n_words") >= 3) & (bad <= 0.02) & (dup <= 0.05) & (F.col("valid") >= 0.98) & (ink >= 0.65) & (F.col("c") >= 0.7)
    return j.select(*PAGE, F.col("text_layer_status").alias("given"), g.rounded(F.col("c")).alias("confidence"), ok.alias("trusted"))


_ROUTE = """CASE WHEN native_characters > 0 AND text_layer_bad_character_ratio < 0.05 AND image_coverage >= 0.72 THEN CASE WHEN text_layer_status IN ('TRUSTED', 'UNTRUSTED') THEN 'OCR' ELSE 'REFUSED' END
    WHEN native_characters > 0 AND text_layer_bad_character_ratio < 0.05 THEN CASE WHEN image_coverage >= 0.35 THEN 'REFUSED' ELSE 'NATIVE' END WHEN image_count > 0 THEN 'OCR' ELSE 'BLANK' END"""


def _routed(spark, d):
    p = table(spark, d, "page_plan").distinct()
    r = rt.route_of(F.col("native_characters"), F.col("text_layer_bad_character_ratio"), F.col("image_coverage"), F.col("image_count"), F.col("text_layer_status"))
    return p.withColumn("computed", r)


@query("route_p7_classes", f"WITH {PLAN} SELECT doc_id, page, {_ROUTE} AS computed, route FROM plan")
def route_p7_classes(spark, d):
    return _routed(spark, d).select(*PAGE, "computed", "route")


@query("join_j15_route_accuracy", f"WITH {PLAN} SELECT doc_id, count(*) AS n_pages, {R(f'avg(CASE WHEN {_ROUTE} = route THEN 1.0 ELSE 0.0 END)')} AS accuracy FROM plan GROUP BY doc_id")
def join_j15_route_accuracy(spark, d):
    """Share of pages whose computed route is the planned one, per document."""
    return _routed(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_pages"), g.rounded(F.avg(F.when(F.col("computed") == F.col("route"), 1.0).otherwise(0.0))).alias("accuracy"))


_COST = "CASE WHEN route = 'BLANK' THEN 5.0 WHEN route = 'NATIVE' THEN 65.0 WHEN searchable_scan THEN 90.0 ELSE 3300.0 + 60.0 * greatest(0.0, render_megapixels - 11.0) END"


@query("cost_m3_page_ms", f"WITH {PLAN} SELECT doc_id, page, route, {_COST} AS prior_ms, {R('width * height * power(coalesce(render_dpi, 0) / 72.0, 2) / 1000000')} AS megapixels FROM plan")
def cost_m3_page_ms(spark, d):
    p = table(spark, d, "page_plan").distinct()
    mp = F.col("width") * F.col("height") * F.pow(F.coalesce("render_dpi", F.lit(0)) / 72.0, F.lit(2)) / 1000000
    return p.select(*PAGE, "route", rt.page_cost(F.col("route"), F.col("render_megapixels"), F.col("searchable_scan")).alias("prior_ms"), g.rounded(mp).alias("megapixels"))


@query(
    "cost_g25_lanes",
    f"""WITH {PLAN}, s AS (SELECT *, route = 'OCR' AND NOT searchable_scan AS scan FROM plan WHERE estimated_ms IS NOT NULL),
      k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, scan ORDER BY estimated_ms DESC, page) AS k, least(4, count(*) FILTER (scan) OVER (PARTITION BY doc_id)) AS n FROM s),
      l AS (SELECT doc_id, CASE WHEN scan THEN (k - 1) % greatest(1, n) ELSE -1 END AS lane, sum(estimated_ms) AS ms, count(*) AS n FROM k GROUP BY ALL)
      SELECT doc_id, sum(n)::BIGINT AS n_pages, {R("coalesce(sum(ms) FILTER (lane < 0), 0)", 1000)} AS other_ms, {R("coalesce(max(ms) FILTER (lane >= 0), 0)", 1000)} AS scan_ms FROM l GROUP BY doc_id""",
)
def cost_g25_lanes(spark, d):
    """Forecast per document with scans dealt to four lanes, longest first."""
    f = rt.forecast(table(spark, d, "page_plan").distinct())
    return f.select("doc_id", "n_pages", g.rounded(F.col("other_ms"), 3).alias("other_ms"), g.rounded(F.col("scan_ms"), 3).alias("scan_ms"))


@query(
    "cost_m5_running",
    f"""WITH {PLAN}, r AS (SELECT doc_id, page, sum(coalesce(estimated_ms, 0)) OVER w AS spent, max(coalesce(estimated_ms, 0)) OVER w AS slowest, count(*) OVER (PARTITION BY doc_id) - row_number() OVER w AS pages_left
        FROM plan WINDOW w AS (PARTITION BY doc_id ORDER BY page, route ROWS UNBOUNDED PRECEDING))
      SELECT doc_id, page, {R("spent", 100)} AS spent_ms, {R("slowest * pages_left * 1.1 + 1500", 100)} AS forecast_ms, spent + slowest * pages_left * 1.1 + 1500 <= 42000 AS fits FROM r""",
)
def cost_m5_running(spark, d):
    """Spent so far, a forecast from the slowest page so far, and whether both fit a time budget."""
    w = Window.partitionBy("doc_id").orderBy("page", "route").rowsBetween(Window.unboundedPreceding, 0)
    ms = F.coalesce("estimated_ms", F.lit(0.0))
    left = F.count("*").over(Window.partitionBy("doc_id")) - F.row_number().over(Window.partitionBy("doc_id").orderBy("page", "route"))
    r = table(spark, d, "page_plan").distinct().select(*PAGE, F.sum(ms).over(w).alias("spent"), F.max(ms).over(w).alias("slowest"), left.alias("left"))
    ahead = F.col("slowest") * F.col("left") * 1.1 + 1500
    return r.select(*PAGE, g.rounded(F.col("spent"), 2).alias("spent_ms"), g.rounded(ahead, 2).alias("forecast_ms"), (F.col("spent") + ahead <= 42000).alias("fits"))


@query(
    "gate_p16_pages",
    f"""WITH s AS (SELECT doc_id, page, count(*) AS n, median(y1 - y0) AS h, median(x1 - x0) AS w, avg(CASE WHEN isnan(confidence) THEN 0 ELSE confidence END) AS c FROM words WHERE text IS NOT NULL GROUP BY ALL)
      SELECT doc_id, page, n, CASE WHEN n > 8 AND h > 1.8 * w THEN 'rotated' WHEN c < 0.55 THEN 'low_confidence' ELSE 'none' END AS reason FROM s""",
)
def gate_p16_pages(spark, d):
    s = table(spark, d, "words").where("text is not null").groupBy(*PAGE).agg(F.count("*").alias("n"), F.median(g.height()).alias("h"), F.median(g.width()).alias("w"), F.avg(F.nanvl("confidence", F.lit(0.0))).alias("c"))
    return s.select(*PAGE, "n", F.when((F.col("n") > 8) & (F.col("h") > 1.8 * F.col("w")), "rotated").when(F.col("c") < 0.55, "low_confidence").otherwise("none").alias("reason"))


@query("text_p18_cell_edges", "SELECT doc_id, page, table_no, row_no, col_no, regexp_replace(regexp_replace(text, '^[|\\[\\]{}]+|[|\\[\\]{}]+$', '', 'g'), '(\\d)\\s*[-–—]$', '\\1') AS text FROM cells WHERE text IS NOT NULL")
def text_p18_cell_edges(spark, d):
    """Cell texts without border marks and without a dash after an amount."""
    t = F.regexp_replace(F.regexp_replace("text", r"^[|\[\]{}]+|[|\[\]{}]+$", ""), r"(\d)\s*[-–—]$", "$1")
    return table(spark, d, "cells").where("text is not null").select(*PAGE, "table_no", "row_no", "col_no", t.alias("text"))


@query("fit_m9_text_width", f"SELECT doc_id, page, block_no, {R('length(text) * size * 0.5')} AS width, ceil(length(text) * size * 0.5 / (x1 - x0))::INT AS least_lines FROM blocks WHERE text IS NOT NULL AND x1 > x0")
def fit_m9_text_width(spark, d):
    w = F.length("text") * F.col("size") * 0.5
    return table(spark, d, "blocks").where("text is not null and x1 > x0").select(*PAGE, "block_no", g.rounded(w).alias("width"), F.ceil(w / (F.col("x1") - F.col("x0"))).cast("int").alias("least_lines"))


@query("fit_m7_wrapped_lines")
def fit_m7_wrapped_lines(spark, d):
    """Lines that a greedy fill of a block's width takes: a fold over its words (rows only)."""
    half, space = F.col("size") * 0.5, F.col("size") * 0.5
    start = F.struct(F.lit(1).alias("lines"), F.lit(0.0).alias("at"))

    def put(acc, w):
        n = F.length(w) * half
        fits = (acc["at"] == 0) | (acc["at"] + space + n <= F.col("x1") - F.col("x0"))
        return F.struct((acc["lines"] + F.when(fits, 0).otherwise(1)).alias("lines"), F.when(fits, acc["at"] + F.when(acc["at"] > 0, space).otherwise(0.0) + n).otherwise(n).alias("at"))

    b = table(spark, d, "blocks").where("text is not null and x1 > x0 and size > 0")
    return b.select(*PAGE, "block_no", "source_lines", F.aggregate(F.filter(F.split("text", r"\s+"), lambda w: w != ""), start, put)["lines"].alias("lines"))


@query("fit_m8_page_scale")
def fit_m8_page_scale(spark, d):
    """The first of twelve (scale, spacing) settings at which the paragraphs of a page fit its height (rows only)."""
    b = table(spark, d, "blocks").where("text is not null and size > 0")
    plan = table(spark, d, "page_plan").select(*PAGE, "width", "height").distinct()
    scales = [1.0, 0.97, 0.94, 0.91, 0.88, 0.85]
    settings = F.explode(F.array(*[F.struct(F.lit(i).alias("k"), F.lit(s).alias("scale"), F.lit(sp).alias("spacing")) for i, (sp, s) in enumerate((sp, s) for sp in (1.1, 1.0) for s in scales)]))
    lines = F.ceil(F.length("text") * F.col("size") * F.col("s.scale") * 0.5 / F.greatest(F.lit(1.0), F.col("width") - 144))
    tall = b.join(plan, PAGE).select(*PAGE, "text", "size", "width", "height", settings.alias("s")).groupBy(*PAGE, "height", "s.k", "s.scale", "s.spacing").agg(F.sum(lines * F.col("size") * F.col("s.scale") * 1.2 * F.col("s.spacing")).alias("total"))
    fits = tall.where(F.col("total") <= (F.col("height") - 144) * 0.94)
    return fits.groupBy(*PAGE).agg(F.min_by(F.struct("scale", "spacing"), "k").alias("s")).select(*PAGE, "s.scale", "s.spacing")


@query(
    "quality_q1_issues",
    """WITH r AS (SELECT doc_id, page, block_no, string_agg(text, '' ORDER BY run_no) AS text FROM runs GROUP BY ALL),
      p AS (SELECT DISTINCT doc_id, page, width, height FROM page_plan),
      grid AS (SELECT doc_id, page, table_no, r, c, count(*) AS n FROM (SELECT doc_id, page, table_no, unnest(range(row_no, row_no + row_span)) AS r, col_no, col_span FROM cells) , unnest(range(col_no, col_no + col_span)) AS u(c) GROUP BY ALL)
      SELECT 'duplicate_page' AS code, doc_id, page, -1 AS item FROM page_plan GROUP BY doc_id, page HAVING count(*) > 1
      UNION ALL SELECT 'block_outside_page', b.doc_id, b.page, block_no FROM blocks b JOIN p USING (doc_id, page) WHERE b.x0 < -2 OR b.y0 < -2 OR b.x1 > width + 2 OR b.y1 > height + 2
      UNION ALL SELECT 'run_text_mismatch', b.doc_id, b.page, b.block_no FROM blocks b JOIN r USING (doc_id, page, block_no) WHERE b.text <> r.text
      UNION ALL SELECT 'run_provenance', doc_id, page, block_no FROM runs WHERE source_page <> page
      UNION ALL SELECT 'invalid_span', doc_id, page, table_no FROM cells WHERE row_span < 1 OR col_span < 1 OR row_no < 0 OR col_no < 0
      UNION ALL SELECT 'overlapping_cells', doc_id, page, table_no FROM grid WHERE n > 1
      UNION ALL SELECT 'low_confidence', doc_id, page, block_no FROM blocks WHERE confidence < 0.5 AND text IS NOT NULL""",
)
def quality_q1_issues(spark, d):
    """One row per violated invariant of pages, blocks, runs and cells."""
    b, runs, cells, plan = (table(spark, d, t) for t in ("blocks", "runs", "cells", "page_plan"))
    p = plan.select(*PAGE, "width", "height").distinct()
    issue = lambda df, code, item: df.select(F.lit(code).alias("code"), *PAGE, item.cast("int").alias("item"))
    out = (F.col("x0") < -2) | (F.col("y0") < -2) | (F.col("x1") > F.col("width") + 2) | (F.col("y1") > F.col("height") + 2)
    r = runs.groupBy(*PAGE, "block_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda s: s["text"]), "").alias("rt"))
    span = lambda a, n: F.explode(F.when(F.col(n) >= 1, F.sequence(F.col(a), F.col(a) + F.col(n) - 1)))
    grid = cells.select(*PAGE, "table_no", "col_no", "col_span", span("row_no", "row_span").alias("r")).select(*PAGE, "table_no", "r", span("col_no", "col_span").alias("c"))
    grid = grid.groupBy(*PAGE, "table_no", "r", "c").agg(F.count("*").alias("n")).where("n > 1")
    parts = [
        issue(plan.groupBy(*PAGE).agg(F.count("*").alias("n")).where("n > 1"), "duplicate_page", F.lit(-1)),
        issue(b.join(p, PAGE).where(out), "block_outside_page", F.col("block_no")),
        issue(b.join(r, [*PAGE, "block_no"]).where("text <> rt"), "run_text_mismatch", F.col("block_no")),
        issue(runs.where("source_page <> page"), "run_provenance", F.col("block_no")),
        issue(cells.where("row_span < 1 or col_span < 1 or row_no < 0 or col_no < 0"), "invalid_span", F.col("table_no")),
        issue(grid, "overlapping_cells", F.col("table_no")),
        issue(b.where("confidence < 0.5 and text is not null and not isnan(confidence)"), "low_confidence", F.col("block_no")),
    ]
    first, *rest = parts
    for x in rest:
        first = first.unionByName(x)
    return first


@query(
    "quality_q3_text_ledger",
    """WITH r AS (SELECT doc_id, page, block_no, string_agg(text, '' ORDER BY run_no) AS text FROM runs GROUP BY ALL)
      SELECT b.doc_id, count(*) AS n_blocks, count(*) FILTER (b.text = r.text) AS n_equal FROM blocks b JOIN r USING (doc_id, page, block_no) WHERE b.text IS NOT NULL GROUP BY b.doc_id""",
)
def quality_q3_text_ledger(spark, d):
    r = table(spark, d, "runs").groupBy(*PAGE, "block_no").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("run_no", "text"))), lambda s: s["text"]), "").alias("rt"))
    return table(spark, d, "blocks").where("text is not null").join(r, [*PAGE, "block_no"]).groupBy("doc_id").agg(F.count("*").alias("n_blocks"), F.count_if(F.col("text") == F.col("rt")).alias("n_equal"))


@query(
    "quality_q4_counts",
    """SELECT doc_id, count(*) FILTER (block_type = 'table') AS n_tables, count(*) FILTER (block_type = 'graphic') AS n_graphics, count(DISTINCT page) AS n_pages, count(DISTINCT size) AS n_sizes,
      count(*) FILTER (length(text) > 350) AS n_long, count(*) FILTER (contains(text, chr(65533))) AS n_replaced FROM blocks GROUP BY doc_id""",
)
def quality_q4_counts(spark, d):
    t = F.col("text")
    return table(spark, d, "blocks").groupBy("doc_id").agg(
        F.count_if(F.col("block_type") == "table").alias("n_tables"), F.count_if(F.col("block_type") == "graphic").alias("n_graphics"), F.count_distinct("page").alias("n_pages"),
        F.count_distinct("size").alias("n_sizes"), F.count_if(F.length(t) > 350).alias("n_long"), F.count_if(t.contains("�")).alias("n_replaced"),
    )


@query(
    "quality_q8_cells",
    """SELECT doc_id, page, table_no, count(*) AS n_cells, count(*) FILTER (coalesce(trim(text), '') = '') AS n_empty, max(row_no + row_span) AS n_rows, max(col_no + col_span) AS n_columns,
      max(row_no + row_span) * max(col_no + col_span) - sum(row_span * col_span)::BIGINT AS n_missing FROM cells GROUP BY ALL""",
)
def quality_q8_cells(spark, d):
    rows, cols = F.max(F.col("row_no") + F.col("row_span")), F.max(F.col("col_no") + F.col("col_span"))
    return table(spark, d, "cells").groupBy(*PAGE, "table_no").agg(
        F.count("*").alias("n_cells"), F.count_if(F.coalesce(F.trim("text"), F.lit("")) == "").alias("n_empty"), rows.alias("n_rows"), cols.alias("n_columns"), (rows * cols - F.sum(F.col("row_span") * F.col("col_span"))).alias("n_missing")
    )


@query(
    "agg_g20_table_confidence",
    f"SELECT doc_id, page, table_no, {R('coalesce(avg(confidence) FILTER (NOT isnan(confidence)), 0.5)', 1000)} AS confidence, count(*) AS n FROM cells GROUP BY ALL",
)
def agg_g20_table_confidence(spark, d):
    c = F.when(~F.isnan("confidence"), F.col("confidence"))
    return table(spark, d, "cells").groupBy(*PAGE, "table_no").agg(g.rounded(F.coalesce(F.avg(c), F.lit(0.5)), 3).alias("confidence"), F.count("*").alias("n"))


@query(
    "agg_g30_printed_height",
    "SELECT doc_id, list_sort(list(y1 - y0))[(count(*) // 2 + 1)::INT] AS height, count(*) AS n FROM words WHERE confidence >= 0.9 AND NOT isnan(confidence) AND length(regexp_replace(text, '[^\\p{L}]', '', 'g')) >= 3 GROUP BY doc_id HAVING count(*) >= 10",
)
def agg_g30_printed_height(spark, d):
    """The middle height of well read words of a document with at least ten."""
    w = table(spark, d, "words").where("confidence >= 0.9 and not isnan(confidence)").where(tx.count_of(F.col("text"), r"\p{L}") >= 3)
    # ranks instead of a collected array: a document is not bounded
    k = F.row_number().over(Window.partitionBy("doc_id").orderBy("h", "page", "word_no"))
    r = w.withColumn("h", g.height()).withColumn("k", k).withColumn("n", F.count("*").over(Window.partitionBy("doc_id")))
    return r.where((F.col("n") >= 10) & (F.col("k") == F.floor(F.col("n") / 2) + 1)).select("doc_id", F.col("h").alias("height"), "n")


@query(
    "agg_g31_block_diagnostics",
    "SELECT doc_id, map_from_entries(list((k, n) ORDER BY k))::VARCHAR AS counts FROM (SELECT doc_id, coalesce(kind, block_type) AS k, count(*) AS n FROM blocks GROUP BY ALL) GROUP BY doc_id",
)
def agg_g31_block_diagnostics(spark, d):
    c = table(spark, d, "blocks").groupBy("doc_id", F.coalesce("kind", "block_type").alias("k")).agg(F.count("*").alias("n"))
    m = F.sort_array(F.collect_list(F.concat_ws("=", "k", "n")))  # a handful of kinds a document
    return c.groupBy("doc_id").agg(F.concat(F.lit("{"), F.array_join(m, ", "), F.lit("}")).alias("counts"))


@query(
    "text_g23_coverage",
    f"""WITH p AS (SELECT doc_id, page, word_no, text AS a, alternative AS b FROM words WHERE alternative IS NOT NULL AND length(text) > 0)
      SELECT doc_id, page, {R("sum((SELECT count(*) FROM unnest(range(1, least(length(a), length(b)) + 1)) AS u(i) WHERE substr(a, i, 1) = substr(b, i, 1)))::DOUBLE / sum(length(a))")} AS coverage FROM p GROUP BY ALL""",
)
def text_g23_coverage(spark, d):
    """Characters that two readings share place by place, per expected character."""
    w = table(spark, d, "words").where("alternative is not null and length(text) > 0")
    exact = F.size(F.filter(F.sequence(F.lit(1), F.least(F.length("text"), F.length("alternative"))), lambda i: F.substring(F.col("text"), i, F.lit(1)) == F.substring(F.col("alternative"), i, F.lit(1))))
    n = F.when(F.length("alternative") == 0, 0).otherwise(exact)
    return w.groupBy(*PAGE).agg(g.rounded(F.sum(n) / F.sum(F.length("text"))).alias("coverage"))


QUERIES, ORACLES = Q, O
