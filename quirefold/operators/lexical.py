"""Tokens against the word list: membership, near words, ranked corrections, verdicts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window


def token(text: Column) -> Column:
    """Lower case without marks around. The dotted capital I of Azerbaijani is an i."""
    return F.regexp_replace(F.lower(F.replace(text, F.lit("İ"), F.lit("i"))), r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}]+$", "")


def token_counts(words: DataFrame) -> DataFrame:
    return words.where("text is not null").groupBy(token(F.col("text")).alias("token")).agg(F.count("*").alias("n")).where("token <> ''")


def word_list(lexicon: DataFrame) -> DataFrame:
    return lexicon.where("word is not null").select(F.lower("word").alias("word")).distinct()


def known(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens with whether the list holds them, or every part between hyphens."""
    parts = tokens.select("token", F.explode(F.split("token", "-")).alias("part"))
    listed = words.withColumn("is_listed", F.lit(True))
    by_part = parts.join(listed, parts["part"] == listed["word"], "left").groupBy("token").agg(F.every(F.coalesce("is_listed", F.lit(False))).alias("parts_listed"))
    whole = listed.select(F.col("word").alias("token"), "is_listed")
    return tokens.join(by_part, "token", "left").join(whole, "token", "left").withColumn(
        "known", F.coalesce("is_listed", F.lit(False)) | (F.contains(F.col("token"), F.lit("-")) & F.coalesce("parts_listed", F.lit(False)))
    ).drop("is_listed", "parts_listed")


def deletions(df: DataFrame, column: str) -> DataFrame:
    """Each text with its forms without one character and itself: two texts within one edit share one."""
    n = F.length(column)
    cut = F.transform(F.sequence(F.lit(1), n), lambda i: F.concat(F.substring(F.col(column), F.lit(1), i - 1), F.substring(F.col(column), i + 1, n)))
    return df.withColumn("form", F.explode(F.array_distinct(F.concat(F.array(F.col(column)), cut))))


# Letters that are read for each other, either way.
LOOKALIKE_PAIRS = (
    "ин", "ип", "нп", "ий", "ьъ", "ьы", "ес", "шщ", "цщ", "зэ", "бв", "кқ", "гғ", "нң", "оө", "уү", "уұ", "үұ", "аә", "хһ", "іи", "ўу", "ҳх", "ӣи", "ӯу", "ҷч", "лп", "тг",
    "sş", "cç", "oö", "uü", "iı", "gğ", "eə", "aä", "nň", "yý", "zž", "il", "ce",
)
# Kazakh and Uzbek letters by the Russian letter that is left when the diacritic is lost.
DIACRITICS = {"kk": {"к": "қ", "г": "ғ", "н": "ң", "о": "ө", "у": "үұ", "а": "ә", "и": "і", "х": "һ"}, "uz": {"к": "қ", "г": "ғ", "у": "ў", "х": "ҳ"}}


def at(text: Column, i: Column, n: int = 1) -> Column:
    return F.substring(text, i, F.lit(n))


def swapped(a: Column, b: Column) -> Column:
    """Whether two texts of one length differ by two neighbours changing places."""
    n = F.length(a)
    turned = lambda i: F.concat(F.substring(a, F.lit(1), i - 1), at(a, i + 1), at(a, i), F.substring(a, i + 2, n))
    return (n == F.length(b)) & (n > 1) & (a != b) & F.exists(F.sequence(F.lit(1), F.greatest(n - 1, F.lit(1))), lambda i: turned(i) == b)


def alike(a: Column, b: Column) -> Column:
    """Whether two texts of one length differ in letters that are read for each other."""
    pairs = [x for p in LOOKALIKE_PAIRS for x in (p, p[::-1])]
    return F.exists(F.sequence(F.lit(1), F.length(a)), lambda i: F.concat(at(a, i), at(b, i)).isin(pairs))


def one_edit(a: Column, b: Column) -> Column:
    return (F.levenshtein(a, b) == 1) | swapped(a, b)


def near_pairs(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """token, word: list words within one edit or one swap. Candidates meet on shared deletion forms, so no pairs
    are compared that share none. A token that is longer than every word by more than one has none."""
    longest = words.agg(F.max(F.length("word"))).scalar()
    t = deletions(tokens.where((F.length("token") >= 2) & (F.length("token") <= longest + 1)), "token").select("token", "form")
    w = deletions(words.where(F.length("word") >= 2), "word").select("word", "form")
    return t.join(w, "form").select("token", "word").distinct().where(one_edit(F.col("token"), F.col("word")))


def corrections(tokens: DataFrame, words: DataFrame, limit: int = 12) -> DataFrame:
    """Ranked list words within one edit of each unknown token: a letter read for its look-alike costs 0, a letter
    added or two swapped 1, a letter lost or replaced 2; equal costs by the word. At most `limit` a token."""
    a, b = F.col("token"), F.col("word")
    longer = F.length(a) - F.length(b)
    cost = F.when(longer > 0, 1).when(longer < 0, 2).when(swapped(a, b), 1).when(alike(a, b), 0).otherwise(2)
    rank = F.row_number().over(Window.partitionBy("token").orderBy("cost", "word"))
    return near_pairs(tokens, words).withColumn("cost", cost).withColumn("place", rank).where(F.col("place") <= limit)


def near_known(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """Tokens of four letters and more that one typical slip parts from a list word: a look-alike letter, a stray letter in
    front, a letter lost inside (not before the third). Endings do not count: they make other forms."""
    a, b = F.col("token"), F.col("word")
    n = F.length(a)
    front = F.substring(a, F.lit(2), n) == b
    inside = (F.length(b) == n + 1) & F.exists(F.sequence(F.lit(3), F.greatest(n, F.lit(3))), lambda i: F.concat(F.substring(b, F.lit(1), i - 1), F.substring(b, i + 1, n)) == a)
    hit = near_pairs(tokens.where(F.length("token") >= 4), words).where((F.length("word") >= 3) & (front | inside | ((n == F.length(b)) & (F.levenshtein(a, b) == 1) & alike(a, b))))
    return hit.groupBy("token").agg(F.min("word").alias("word"))


def diacritic_slips(tokens: DataFrame, lexicon: DataFrame) -> DataFrame:
    """token, lang, word: Cyrillic tokens that neither the language's list nor the Russian one holds, and
    that one diacritic put back makes a word of the language."""
    cyrillic = tokens.where((F.length("token") >= 3) & F.col("token").rlike(r"^\p{IsCyrillic}+$"))
    lists = lexicon.where(F.col("word").isNotNull()).select("lang", F.lower("word").alias("word")).distinct()
    russian = lists.where("lang = 'ru'").select(F.col("word").alias("token"))
    out = None
    for lang, table in DIACRITICS.items():
        own = lists.where(F.col("lang") == lang).select("word")
        free = cyrillic.join(russian, "token", "left_anti").join(own.select(F.col("word").alias("token")), "token", "left_anti")
        put = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(x).alias("x")) for k, v in table.items() for x in v]))
        i = F.explode(F.sequence(F.lit(1), F.length("token")))
        changed = free.select("token", i.alias("i")).select("token", "i", put.alias("p")).where(at(F.col("token"), F.col("i")) == F.col("p.k"))
        word = F.concat(F.substring("token", F.lit(1), F.col("i") - 1), F.col("p.x"), F.substring(F.col("token"), F.col("i") + 1, F.length("token")))
        hit = changed.select("token", word.alias("word")).join(own, "word").groupBy("token").agg(F.min("word").alias("word")).select("token", F.lit(lang).alias("lang"), "word")
        out = hit if out is None else out.unionByName(hit)
    return out
