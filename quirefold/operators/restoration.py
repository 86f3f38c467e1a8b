"""Restoring read words: option labels, bullets, alphabets, halves, similar readings, ranked candidates."""

from __future__ import annotations

import difflib
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions.geometry import height
from quirefold.functions.text import count_of
from quirefold.operators.layout import PAGE, by_page, with_line
from quirefold.operators.lexical import corrections, token, word_list

# Shapes that option labels of Cyrillic lists take, and letters that pass for a bullet.
LABEL_SHAPES = {"a": "а", "6": "б", "B": "в", "r": "г", "e": "е"}
BULLET_SHAPES = "eoc•©°*·"
# Uzbek Latin letters and digraphs in Cyrillic.
UZ_PAIRS = (("sh", "ш"), ("ch", "ч"), ("oʻ", "ў"), ("gʻ", "ғ"), ("ya", "я"), ("yu", "ю"), ("yo", "ё"), ("ye", "е"), ("ts", "ц"))
UZ_LETTERS = dict(zip("abdefghijklmnopqrstuvxyz", "абдефгҳижклмнопқрстувхйз"))


def case_like(word: Column, model: Column) -> Column:
    """The word in the case of a model: all capitals, a capital first, or as it is."""
    shout = (F.upper(model) == model) & (F.length(F.regexp_replace(model, r"\P{L}", "")) > 1)
    return F.when(shout, F.upper(word)).when(model.rlike(r"^\p{Lu}"), F.concat(F.upper(F.left(word, F.lit(1))), F.substring(word, F.lit(2), F.length(word)))).otherwise(word)


def option_labels(words: DataFrame) -> DataFrame:
    """Labels `x)` of a line with at least two of them, one a letter of a known shape, as Cyrillic letters."""
    w = with_line(words.where("text is not null")).where(F.col("text").rlike(r"^[^\W_]\)$|^[\p{L}\d]\)$"))
    line = Window.partitionBy(*PAGE, "line_key")
    first = F.left("text", F.lit(1))
    shapes = F.create_map(*[F.lit(x) for k, v in LABEL_SHAPES.items() for x in (k, v)])
    to = F.coalesce(F.try_element_at(shapes, first), first)
    lettered = F.max(F.when(first.rlike(r"\p{L}") & (first.isin(*LABEL_SHAPES) | first.isin(*LABEL_SHAPES.values(), "д")), 1).otherwise(0)).over(line)
    w = w.withColumns({"n": F.count("*").over(line), "lettered": lettered, "label": F.concat(to, F.lit(")"))})
    return w.where("n >= 2 and lettered = 1 and label <> text").select(*PAGE, "word_no", "text", "label")


def bullets(words: DataFrame) -> DataFrame:
    """First words of lines that pass for a bullet and stand half their height apart from what follows."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    w = with_line(words.where("text is not null")).withColumns({"k": F.row_number().over(line), "gap": F.lead("x0").over(line) - F.col("x1")})
    return w.where((F.col("k") == 1) & (F.length("text") == 1) & F.col("text").isin(*BULLET_SHAPES) & (F.col("text") != "•") & (F.col("gap") >= 0.5 * height())).select(*PAGE, "word_no", "text")


def line_alphabets(words: DataFrame) -> DataFrame:
    """Words with the alphabet that most letters of their line, at least three, are written in."""
    w = with_line(words.where("text is not null"))
    c, l = count_of(F.col("text"), r"\p{IsCyrillic}"), count_of(F.col("text"), r"\p{IsLatin}")
    line = Window.partitionBy(*PAGE, "line_key")
    w = w.withColumns({"lc": F.sum(c).over(line), "ll": F.sum(l).over(line)})
    return w.withColumn("line_script", F.when(F.col("lc") + F.col("ll") < 3, None).when(F.col("lc") > F.col("ll"), "Cyrillic").otherwise("Latin")).drop("lc", "ll")


def similarity(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """Adds `ratio`: twice the characters of matching blocks over all characters, in lower case."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema.fields) + ", ratio double"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            a, b = pdf[left].tolist(), pdf[right].tolist()
            yield pdf.assign(ratio=pd.Series([difflib.SequenceMatcher(None, x.lower(), y.lower()).ratio() if x and y else 0.0 for x, y in zip(a, b)], dtype=float, index=pdf.index))

    return pairs.mapInPandas(add, schema)


def cyrillic_spellings(words: DataFrame, column: str = "word", most: int = 16) -> DataFrame:
    """Uzbek Latin words with their Cyrillic spellings; a word with other letters has none."""
    schema = f"`{column}` string, spelling string"
    pairs = dict(UZ_PAIRS)

    def spell(w: str) -> list[str]:
        out, i = [""], 0
        while i < len(w):
            if w[i : i + 2] in pairs:
                more, i = [pairs[w[i : i + 2]]], i + 2
            elif w[i] == "ʻ":
                more, i = ["ъ"], i + 1
            elif w[i] in UZ_LETTERS:
                more, i = ["э" if w[i] == "e" and not out[0] else UZ_LETTERS[w[i]]], i + 1
            else:
                return []
            out = [o + m for o in out for m in more][:most]
        return out

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(w, s) for w in pdf[column].tolist() for s in (spell(w.lower()) if w else [])]
            yield pd.DataFrame(rows, columns=[column, "spelling"])

    return words.select(column).distinct().mapInPandas(run, schema)


def halves(words: DataFrame) -> DataFrame:
    """Neighbouring words of a line whose joined text is what the second reading has for the first."""
    line = Window.partitionBy(*PAGE, "line_key").orderBy("x0", "word_no")
    w = with_line(words.where("text is not null")).withColumns({"after": F.lead("text").over(line), "after_no": F.lead("word_no").over(line)})
    return w.where((F.col("alternative") != "") & (F.concat("text", "after") == F.col("alternative"))).select(*PAGE, "word_no", "after_no", F.col("alternative").alias("joined"))


# Equal glyphs of the two alphabets, and the least likeness of a candidate and a reading.
TO_CYRILLIC, TO_LATIN, SIMILAR = ("ABCEHKMOPTXYaceopxy", "АВСЕНКМОРТХУасеорху"), ("АВСЕНКМОРТХУасеорху", "ABCEHKMOPTXYaceopxy"), 0.6


def _script_of(text: Column) -> Column:
    c, l = count_of(text, r"\p{IsCyrillic}"), count_of(text, r"\p{IsLatin}")
    return F.when((c > 0) & (l > 0), "mixed").when(c > 0, "Cyrillic").when(l > 0, "Latin")


def _closest(df: DataFrame) -> DataFrame:
    """Adds `close`: the greater likeness of `to` with the core and with the second reading."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields) + ", close double"

    def add(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        same = str.maketrans(*TO_CYRILLIC)  # equal glyphs are alike
        like = lambda a, b: difflib.SequenceMatcher(None, a.translate(same).lower(), b.translate(same).lower()).ratio() if a and b else 0.0
        for pdf in batches:
            yield pdf.assign(close=pd.Series([max(like(t, c), like(t, o)) for t, c, o in zip(pdf["to"], pdf["part"], pdf["other"])], dtype=float, index=pdf.index))

    return df.mapInPandas(add, schema)


def restored(words: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Unlisted words with their best restoration: doc_id, page, word_no, text, restored, score, how.

    Readings are the word (2), its second reading (1) and either in the look-alikes of its line's alphabet (.2 less). A reading that is a
    word scores 10, in the line's alphabet without being listed 7, a list word one slip away 6 less half its rank plus half the
    reading's weight; 3 more for a word the page uses, twice the likeness with the readings (at least SIMILAR), and once more 3 for the
    page's use. Capitalised words may be names: only words the page uses replace them. A cut-off form is no candidate. Parts between hyphens are restored
    one by one and count only if all are words. A word no candidate fits, or whose own reading is the best, has no row."""
    listed = word_list(lexicon)
    core = lambda c: F.regexp_extract(c, r"^[^\p{L}\p{N}]*(.*?)[^\p{L}\p{N}]*$", 1)
    line = Window.partitionBy(*PAGE, "line_key")
    w = with_line(words.where("text is not null")).withColumns({"core": core(F.col("text")), "second": core(F.coalesce("alternative", F.lit(""))), "token": token(F.col("text"))})
    c, l = F.sum(count_of(F.col("text"), r"\p{IsCyrillic}")).over(line), F.sum(count_of(F.col("text"), r"\p{IsLatin}")).over(line)
    w = w.withColumn("line_script", F.when(c + l >= 3, F.when(c > l, "Cyrillic").when(l > c, "Latin")))
    used = w.where("confidence >= 0.8 and not isnan(confidence)").select(*PAGE, F.col("token").alias("k")).distinct()
    used = used.join(listed, F.col("k") == F.col("word"), "left_semi").withColumn("used", F.lit(True))  # misreadings of the page are no words of it
    bad = w.where((F.length("core") >= 2) & ~F.col("core").rlike(r"\p{Nd}|@")).join(listed, F.col("token") == F.col("word"), "left_anti")
    parts = bad.select(*PAGE, "word_no", "text", "core", "line_script", F.size(F.split("core", "-")).alias("n"), F.col("second").alias("other"), F.posexplode(F.split("core", "-")).alias("no", "part"))
    other = F.when((F.col("n") == 1) & (F.col("other") != F.col("core")) & ~F.col("other").rlike(r"\p{Nd}"), F.col("other")).otherwise("")
    parts = parts.withColumn("other", other)
    as_line = lambda r: F.when(F.col("line_script") == "Cyrillic", F.translate(r, *TO_CYRILLIC)).when(F.col("line_script") == "Latin", F.translate(r, *TO_LATIN))
    row = lambda r, weight, how: F.struct(r.alias("reading"), F.lit(weight).alias("weight"), F.lit(how).alias("how"))
    alphabet = [row(as_line(r), x - 0.2, "alphabet") for r, x in ((F.col("part"), 2.0), (F.col("other"), 1.0))]
    own = [row(F.col("part"), 2.0, "reading"), row(F.col("other"), 1.0, "second reading")]
    read = parts.select("*", F.explode(F.array(*own, *alphabet)).alias("r")).select(*parts.columns, "r.*").where("reading <> ''")
    read = read.where((F.col("how") != "alphabet") | ~F.lower("reading").isin(F.lower("part"), F.lower("other")))
    script = _script_of(F.col("reading"))
    read = read.where((F.coalesce(script, F.lit("")) != "mixed") & (F.col("line_script").isNull() | script.isNull() | (script == F.col("line_script"))))
    low = F.lower("reading")
    read = read.join(listed.select(F.col("word").alias("is"), F.lit(True).alias("known")), low == F.col("is"), "left").drop("is")
    cols = [*parts.columns, "reading", "weight", "how", "to", "base"]
    self_ = read.withColumns({"to": F.col("reading"), "base": F.when(F.col("known"), 10.0).when((F.col("how") == "alphabet") & (F.length("reading") >= 3), 7.0) + F.col("weight")}).where("base is not null").select(*cols)
    ranked = corrections(read.where("known is null").select(F.lower("reading").alias("token")).distinct(), listed, limit=8).select(F.col("token").alias("t"), F.col("word").alias("to"), "place")
    near = read.where("known is null").join(ranked, low == F.col("t")).where(((F.length("reading") > 2) | (F.length("to") == F.length("reading"))) & ~F.startswith(low, F.col("to")))
    near = near.withColumns({"base": 6.0 - 0.5 * (F.col("place") - 1) + 0.5 * F.col("weight"), "how": F.lit("word list")}).select(*cols)
    cand = self_.unionByName(near).withColumn("k", F.lower("to")).join(used, [*PAGE, "k"], "left").drop("k")
    in_use = F.coalesce("used", F.lit(False))
    proper = F.col("core").rlike(r"^\p{Lu}")
    cut = (F.length("to") < F.length("part")) & F.startswith(F.lower("part"), F.lower("to"))
    cand = _closest(cand.where(~cut & (~proper | in_use | (F.col("how") == "alphabet") | (F.col("to") == F.col("part"))))).where(F.col("close") >= SIMILAR)
    score = F.col("base") + 2 * F.col("close") + F.when(F.coalesce("used", F.lit(False)), 6.0).otherwise(0.0)
    best = cand.withColumn("score", score).groupBy(*PAGE, "word_no", "no").agg(F.max(F.struct("score", (F.lit(0) - F.length("to")).alias("k"), "to", "how")).alias("b"))
    done = parts.join(best, [*PAGE, "word_no", "no"], "left").join(listed.select(F.col("word").alias("is"), F.lit(True).alias("known")), F.lower("part") == F.col("is"), "left")
    fine = F.col("b").isNotNull() | (F.length("part") < 3) | F.coalesce("known", F.lit(False))
    piece = F.when(F.col("known") | F.col("b").isNull(), F.col("part")).otherwise(case_like(F.col("b.to"), F.col("part")))
    whole = done.groupBy(*PAGE, "word_no", "text", "core").agg(
        F.every(fine).alias("fine"), F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("no", piece.alias("p")))), lambda x: x["p"]), "-").alias("new"), F.min("b.score").alias("score"), F.max_by("b.how", "b.score").alias("how")
    )  # the parts of one word
    new = F.replace("text", F.col("core"), F.col("new"))
    return whole.where(F.col("fine") & (F.col("new") != F.col("core"))).select(*PAGE, "word_no", "text", new.alias("restored"), "score", "how")


def _labels_of_page(rows: list[tuple], gap: float) -> list[tuple]:
    """The rows (doc_id, page, x0, y0, id, x1, y1), sorted by x0, with the least id of their group: a sweep over x
    keeps the boxes that may still be near, a forest joins those that are."""
    parent = list(range(len(rows)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = i = parent[parent[i]]
        return i

    open_: list[int] = []
    for i, (_, _, x0, y0, _, _, y1) in enumerate(rows):
        open_ = [j for j in open_ if rows[j][5] >= x0 - gap]
        for j in open_:
            if min(y1, rows[j][6]) - max(y0, rows[j][3]) >= -gap:
                parent[root(i)] = root(j)
        open_.append(i)
    least: dict[int, int] = {}
    for i, r in enumerate(rows):
        k = root(i)
        least[k] = min(least.get(k, r[4]), r[4])
    return [(r[0], r[1], r[4], least[root(i)]) for i, r in enumerate(rows)]


def merged_boxes(boxes: DataFrame, gap: float = 6.0) -> DataFrame:
    """Boxes of a page with the least id of those they are connected to by nearness. Groups never leave their page, so one pass over
    hashed pages does. Boxes with a null corner are left out."""
    b = boxes.select(*PAGE, "x0", "y0", "id", "x1", "y1").where("x0 is not null and y0 is not null and x1 is not null and y1 is not null")
    return by_page(b, ["x0", "y0"], lambda rows: _labels_of_page(rows, gap), "doc_id bigint, page int, id bigint, label bigint")
