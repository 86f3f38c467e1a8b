"""Problem 2: noise in text from scanned pages - misread words, words broken at line ends, running
headers and page numbers - and its repair into continuous paragraphs.

Misread words: the anagram hash of a word is the sum of a number per character, so that a confusion
(rn read for m) changes it by a fixed difference. Rare words are joined in SQL with frequent or listed
words whose hash differs by one difference, or by two met halfway; an edit distance check drops
anagrams. Corrections are ranked by listing, differences and frequency. Han characters that no listed
word holds are paired with the characters that make listed words of their surroundings, and a pair is
accepted by its share of the character's occurrences. Broken words: a mark at a line end whose halves
join to a word, unless the compound with its own hyphen is a word. Edge lines: short first lines that
recur over documents and hardly ever stand elsewhere on a page, or that recur over the pages of one
document, are running headers; page numbers have a form. Headers meet the blocks in joins, never on the driver.

Repair: every finding of a block is an edit of a stretch of its text; the edits of a block are
applied together and what is left of a paragraph is set on one line (`repaired`).

Defined results: only pages whose plan routes them to OCR count; null text has no noise; garbled words
(problem 3) are no misreadings; equal corrections are ordered by the word itself.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.llm.encoding import Garbling
from quirefold.llm.lookalike import Lookalikes
from quirefold.llm.wordlist import list_rows
from quirefold.session import spread, staged

# What is printed and what is read for it.
CONFUSIONS = (
    "o 0|o a|a o|e c|c e|e o|i l|l i|l 1|i 1|I l|t f|f t|s 5|g 9|z 2|b 6|d cl|m rn|n ri|u ii|w vv|h b|b h|n u|u n|y v|q g|g q|rn m|cl d|ri n|vv w|a e|ı i|ı l|i ı|ə e|ə a|ş s|ç c|ğ g|ö o|ü u|B 8|8 B|S 5|r t|j i|v y|k lc|k h"
    "|о 0|а о|о а|н и|и н|т г|г т|л п|п л|б 6|в 8|ч 4|з 3|ы ь1|ы ьl|е с|с е|е с||ш щ|щ ш|й и|и й|м н|н м|п н|н п|к х|ж х|ғ г|қ к|ң н|ө о|ұ у|ү у|і i|і 1|ц и|э з|я л|ю о|д л|х к|у ч|р п|ь б|о с|с о|ё е|ә о"
)
_SKELETONS = ("بتثنيپىئی", "جحخچ", "دذ", "رزژ", "سش", "صض", "طظ", "عغ", "فق", "کگ", "كگ", "ةه", "أاإآ", "وؤ")
STRAY = "~^*|\\_"
HYPHEN_MARKS = "-–¬‐"
_EDGE = ".,;:!?()[]{}«»“”„‘’\"'…،؛؟。，：；、—–-·•！？（）"
_HAN = re.compile(r"[㐀-鿿]")
_HAN_RUN = re.compile(r"[㐀-鿿]+")
_INNER_DIGIT = re.compile(r"[a-zß-ɏʻа-ӿ]\d{1,2}[a-zß-ɏʻа-ӿ]")
_STRAY_IN = re.compile(r"[^\W\d_][~^*|\\]+|[~^*|\\]+[^\W\d_]|[a-zß-ʯа-ӿ]_[a-zß-ʯа-ӿ]")
_BREAK = re.compile(r"([^\W\d_][^\s]*)([\-–¬‐])[^\S\n]*(\n?)[^\S\n]*(?=([^\W\d_]))")
_TOKEN = re.compile(r"\S+")
_ADDRESS = re.compile(r"@|\(at\)|\[at\]|\.\w+\.|://|www\.")

# Page numbers as written in the languages of the texts.
PAGE_NUMBER = (
    r"(?:page|pagc|p\.|pp\.|стр\.|с\.|бет|bet|səh\.|صفحة|صفحه|ص\.)\s*[-–]?\s*[0-9oOlI٠-٩۰-۹]{1,4}(?:\s*(?:of|из|/|من|از)\s*[0-9oOlI٠-٩۰-۹]{1,4})?"
    r"|[0-9٠-٩۰-۹]{1,4}\s*[-–]?\s*(?:бет|bet|səh\.|с\.|стр\.)"
    r"|第\s*[0-9]{1,4}\s*页(?:\s*共\s*[0-9]{1,4}\s*页)?"
    r"|[-–—]\s?[0-9oOlI٠-٩۰-۹]{1,4}\s?[-–—]"
    r"|(?:page|pagc|стр\.)\s*\S{1,4}\s(?:of|из)\s\S{1,4}"
)
_PAGE_ALONE = rf"(?i)^\s*(?:{PAGE_NUMBER}|[-–—]?\s?[0-9oOlI٠-٩۰-۹]{{1,4}}\s?[-–—]?)[\s.]*$"
_PAGE_LINE = rf"(?im)^[^\S\n]*(?:{PAGE_NUMBER}|[0-9٠-٩۰-۹]{{1,4}})[^\S\n]*$"
_PAGE_INSIDE = (
    r"(?:^|\s)(?:[Pp]ag[ec] \d{1,4} of \d{1,4}|[Сс]тр\. \d{1,4} из \d{1,4}|[-–] \d{1,4} [-–]|第\d{1,4}页共?\d{0,4}页?)(?=\s|$)"
    r"|[.!?。»”]\s+(?:p\. \d{1,4}|с\. \d{1,4}|-\d{1,4}-|\d{1,4} бет|\d{1,4} bet|\d{1,4} səh\.|صفحة \d{1,4}|صفحه \d{1,4}|第\d{1,4}页)\s*$"
    r"|[.!?。»”][^\S\n]*\s[0-9٠-٩۰-۹]{1,3}\s*$"
    r"|[\p{Ll}\p{Lo}] (?:p\. \d{1,4}|с\. \d{1,4}|-\d{1,4}-|\d{1,4} səh\.|\d{1,4} бет|\d{1,4} bet|صفحة \d{1,4}|صفحه \d{1,4}) (?=[\p{Ll}\p{Lo}])"
    r"|[\p{Lo}。，]第\d{1,4}页[\p{Lo}]"
)


_ALONE = re.compile(_PAGE_ALONE)
# A page number at the end of a paragraph or between its words.
_PAGES_IN = re.compile(
    r"((?:^|\s))(?:[Pp]ag[ec] \d{1,4} of \d{1,4}|[Сс]тр\. \d{1,4} из \d{1,4}|[-–] \d{1,4} [-–]|第\d{1,4}页(?:共\d{1,4}页)?)(?=\s|$)"
    r"|([.!?。»”])\s+(?:p\. \d{1,4}|с\. \d{1,4}|-\d{1,4}-|\d{1,4} бет|\d{1,4} bet|\d{1,4} səh\.|صفحة \d{1,4}|صفحه \d{1,4}|第\d{1,4}页|[0-9٠-٩۰-۹]{1,3})\s*$"
)


def _pairs() -> list[tuple[str, str]]:
    out = []
    for p in CONFUSIONS.replace("е с||", "е с\u0001|").split("|"):
        a, _, b = p.partition(" ")
        out.append((a, b.replace("\u0001", "|")))
    out += [(a, b) for s in _SKELETONS for a in s for b in s if a != b]
    out += [("", x) for x in STRAY]
    return sorted(set(out))


def letters_hash(text: Column) -> Column:
    """The anagram hash: the sum of a fixed number per character."""
    one = lambda c: F.pmod(F.xxhash64(c), F.lit(1 << 50))
    return F.aggregate(F.split(text, ""), F.lit(0).cast("long"), lambda a, c: F.when(c == "", a).otherwise(a + one(c)))


class Reader:
    """Tokens of scanned text with what is needed to judge them."""

    def __init__(self, looks: Lookalikes, garbling: Garbling, lexicon: list[str]):
        self.looks, self.garbling = looks, garbling
        self.listed = {w.lower() for w in lexicon}
        self.han_words = [w for w in sorted(self.listed) if len(w) > 1 and _HAN_RUN.fullmatch(w)]
        self.han_known = set("".join(w for w in self.listed if _HAN.search(w)))
        masks: dict[tuple[str, int, int], set[str]] = defaultdict(set)
        for w in self.han_words:
            for i, ch in enumerate(w):
                masks[(w[:i] + "?" + w[i + 1 :], i, len(w))].add(ch)
        self.masks = dict(masks)
        self.cache: dict[str, str | None] = {}

    def core(self, token: str) -> str | None:
        """Lower case, one form of characters, without marks around; None for garbled tokens."""
        c = self.cache.get(token, "")
        if c != "":
            return c
        if not token.isascii() and self.garbling.verdict(token)[0] in ("sure", "lost"):
            c = None
        else:
            c = self.looks.token(token).strip(_EDGE).lower() or None
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[token] = c
        return c

    def known(self, core: str) -> bool:
        return core in self.listed or "-" in core and all(p in self.listed for p in core.split("-") if p)

    def odd(self, token: str) -> bool:
        """Characters that no printed word holds."""
        if _ADDRESS.search(token):
            return False
        return bool(_STRAY_IN.search(token) or _INNER_DIGIT.search(token))

    def han(self, run: str) -> Iterator[tuple[str, str | None, int]]:
        """(character, character that makes a listed word of its surroundings, place) for unlisted ones."""
        for i, ch in enumerate(run):
            if ch in self.han_known:
                continue
            yield ch, None, i
            seen = set()
            for n in (2, 3, 4):
                for k in range(max(0, i - n + 1), min(i, len(run) - n) + 1):
                    piece = run[k : k + n]
                    for r in self.masks.get((piece[: i - k] + "?" + piece[i - k + 1 :], i - k, n), ()):
                        if r not in seen:
                            seen.add(r)
                            yield ch, r, i


_SCHEMA = "src string, doc_id bigint, page int, item_no int, mode string, core string, whole string, half int, other_no int, a int, b int, n bigint"


def _known(seen: Counter) -> Iterator[tuple]:
    """Listed words of a batch: they are never corrected, so only their counts go on."""
    for core, n in seen.items():
        yield "", -1, -1, -1, "known", core, None, None, None, None, None, n


def _rows_of_words(r: Reader, pdf: pd.DataFrame) -> Iterator[tuple]:
    known: Counter = Counter()
    for d, p, no, t, nt, broken, alt, before in pdf[["doc_id", "page", "word_no", "text", "next_text", "line_break", "alternative", "text_before"]].itertuples(index=False):
        row = lambda mode, core, whole=None, half=None, other=None: ("words", d, p, no, mode, core, whole, half, other, None, None, 1)
        if broken and len(t) > 1 and t[-1] in HYPHEN_MARKS and t[-2].isalpha() and nt and nt[0].isalpha():
            a, b = r.core(t[:-1]), r.core(nt)
            if a and b:
                yield row("join" if t[-1] == "-" else "mark", a + b, f"{a}-{b}", len(a), no + 1)
                if r.odd(t[:-1]):
                    yield row("odd", a)
                continue
        c = r.core(t)
        if not c:
            continue
        if before and len(before) > 1 and before[-1] in HYPHEN_MARKS and before[-2].isalpha() and c[0].isalpha():
            if r.odd(t):
                yield row("odd", c)
            continue  # the second half of a broken word is judged with the first
        if _HAN.search(c):
            for run in _HAN_RUN.findall(c):
                for ch, x, _ in r.han(run):
                    yield row("han" if x is None else "han_pair", ch, x)
        if c in r.listed:
            known[c] += 1
        else:
            yield row("word", c)
        if r.odd(t):
            yield row("odd", c)
        if alt and alt != t and not r.known(c):
            k = r.core(alt)
            if k and k != c and r.known(k) and abs(len(k) - len(c)) < 3:
                yield row("second", c, k)
    yield from _known(known)


def _rows_of_blocks(r: Reader, pdf: pd.DataFrame) -> Iterator[tuple]:
    known: Counter = Counter()
    for d, p, no, t in pdf[["doc_id", "page", "block_no", "text"]].itertuples(index=False):
        row = lambda mode, core, a, b, whole=None, half=None: ("blocks", d, p, no, mode, core, whole, half, None, a, b, 1)
        gone: list[tuple[int, int]] = []
        for m in _BREAK.finditer(t):
            b = _TOKEN.match(t, m.end())
            if b is None:
                continue
            left, right = r.core(m[1]), r.core(b[0])
            if not left or not right:
                continue
            between = t[m.start(2) + 1 : m.end()]
            mode = "mark" if m[2] in "¬–" and (between or r.known(left + right)) else "join" if between else "inner"
            if mode == "inner" and (r.known(f"{left}-{right}") or "-" in left):
                continue
            yield row(mode, left + right, m.start(), b.end(), f"{left}-{right}", len(left))
            gone.append((m.start(), b.end()))
        k = 0
        for m in _TOKEN.finditer(t):
            while k < len(gone) and gone[k][1] <= m.start():
                k += 1
            if k < len(gone) and gone[k][0] < m.end():
                if r.odd(m[0]):
                    yield row("odd", m[0], *m.span())
                continue
            c = r.core(m[0])
            if not c:
                continue
            if _HAN.search(c):
                for run in _HAN_RUN.finditer(m[0]):
                    for ch, x, i in r.han(run[0]):
                        at = m.start() + run.start() + i
                        yield row("han" if x is None else "han_pair", ch, at, at + 1, x)
                continue
            if c in r.listed:
                known[c] += 1
            else:
                yield row("word", c, *m.span())
            if r.odd(m[0]):
                yield row("odd", c, *m.span())
    yield from _known(known)


def _mapper(shared, rows_of):
    cols = [c.split()[0] for c in _SCHEMA.split(", ")]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for pdf in batches:
            out = pd.DataFrame(list(rows_of(reader, pdf)), columns=cols)
            yield out.astype({"half": "Int32", "other_no": "Int32", "a": "Int32", "b": "Int32"})

    return run


def _cores(shared):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        reader = Reader(*shared.value)
        for pdf in batches:
            c = [reader.core(t) for t in pdf["text"].tolist()]
            keep = [i for i, x in enumerate(c) if x and not (pdf["block"].iat[i] and _HAN.search(x))]
            yield pd.DataFrame({"core": [c[i] for i in keep], "n": pdf["n"].iloc[keep].tolist()})

    return run


def _ocr_pages(plan: DataFrame) -> DataFrame:
    return plan.groupBy("doc_id", "page").agg(F.bool_or(F.col("route") == "OCR").alias("ocr")).where("ocr").select("doc_id", "page")


def scan_tokens(words: DataFrame, blocks: DataFrame, plan: DataFrame, looks: Lookalikes, garbling: Garbling, lexicon: list[str]) -> tuple[DataFrame, DataFrame]:
    """The unlisted tokens of the words and block texts of pages read by OCR, the counts of the listed ones, and the candidates of breaks and odd
    characters; and the counts of the tokens of all other pages (core, n), whose spellings are only read once each."""
    shared = words.sparkSession.sparkContext.broadcast((looks, garbling, lexicon))
    pages = _ocr_pages(plan)
    at = Window.partitionBy("doc_id", "page").orderBy("word_no")
    words, blocks = words.where(F.col("text").isNotNull()), blocks.where(F.col("text").isNotNull())
    w = (
        words.join(pages, ["doc_id", "page"])
        .select("doc_id", "page", "word_no", "text", "alternative", "line_id")
        .select(
            "doc_id", "page", "word_no", "text", "alternative", F.lead("text").over(at).alias("next_text"),
            F.when(F.lag("line_id").over(at) != F.col("line_id"), F.lag("text").over(at)).alias("text_before"),
            F.coalesce(F.lead("line_id").over(at) != F.col("line_id"), F.lit(False)).alias("line_break"),
        )
    )
    b = blocks.select("doc_id", "page", "block_no", "text").join(pages, ["doc_id", "page"])
    tokens = w.mapInPandas(_mapper(shared, _rows_of_words), _SCHEMA).unionByName(spread(b, "doc_id", "page", "block_no").mapInPandas(_mapper(shared, _rows_of_blocks), _SCHEMA))
    plain = words.join(pages, ["doc_id", "page"], "left_anti").select("text", F.lit(False).alias("block"))
    flow = blocks.join(pages, ["doc_id", "page"], "left_anti").select(F.explode(F.regexp_extract_all("text", F.lit(r"(\S+)"), F.lit(1))).alias("text"), F.lit(True).alias("block"))
    seen = plain.unionByName(flow).groupBy("text", "block").agg(F.count("*").alias("n"))
    return staged(tokens, "scan-tokens"), seen.mapInPandas(_cores(shared), "core string, n long").groupBy("core").agg(F.sum("n").alias("n"))


def misreadings(tokens: DataFrame, native: DataFrame, lexicon: DataFrame) -> DataFrame:
    """core, its correction: rare words joined with confusable frequent or listed ones."""
    spark = tokens.sparkSession
    scanned = tokens.where("mode in ('word', 'known', 'join', 'mark', 'inner')").groupBy("core").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("mode").isin("word", "known"), F.col("n")).otherwise(0)).alias("n_word"), F.lit(False).alias("native"))
    count = scanned.unionByName(native.select("core", "n", F.col("n").alias("n_word"), F.lit(True).alias("native"))).groupBy("core").agg(F.sum("n").alias("n"), F.sum("n_word").alias("n_word"), F.bool_or("native").alias("native"))
    listed = lexicon.where(F.col("word").isNotNull()).select(F.lower("word").alias("core")).distinct().withColumn("listed", F.lit(True))
    vocab = (
        count.join(listed, "core", "full")
        .select("core", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("n_word", F.lit(0)).alias("n_word"), F.coalesce("native", F.lit(False)).alias("native"), F.coalesce("listed", F.lit(False)).alias("listed"))
        .where(F.length("core") >= 2)
        .withColumn("whole", F.col("listed") | (F.instr("core", "-") > 0) & F.col("native"))
        .withColumn("h", letters_hash(F.col("core")))
    )
    vocab = staged(vocab, "scan-vocab")
    rare = vocab.where(~F.col("listed") & ~F.col("native") & F.col("core").rlike(r"\p{L}") & ~F.col("core").rlike(r"^\P{L}*\p{L}?-?\d+/\d+\P{L}*$|@|^[\p{IsHan}\d]+$")).select("core", "n", "h")
    steady = vocab.where((F.col("listed") | (F.col("n_word") >= 3)) & ~F.col("core").rlike(r"@|^[\p{IsHan}\d]+$"))
    deltas = spark.createDataFrame(_pairs(), "printed string, seen string").select(
        (letters_hash(F.col("seen")) - letters_hash(F.col("printed"))).alias("delta"), F.greatest(F.length("printed"), F.length("seen")).alias("edits"), "printed", "seen"
    )
    steady = steady.select(F.col("core").alias("word"), F.col("n_word").alias("word_n"), F.col("listed").alias("word_listed"), F.col("h").alias("word_h"))
    table = F.array(*[F.struct(F.lit(a).alias("printed"), F.lit(b).alias("seen")) for a, b in _pairs()])  # fixed, a few hundred pairs

    def with_deltas(df: DataFrame, column: str, side: str) -> DataFrame:
        hit = df.select("*", F.explode(F.filter(table, lambda x: F.contains(F.col(column), x[side]) if side == "seen" else (x[side] == "") | F.contains(F.col(column), x[side]))).alias("pair"))
        return hit.join(F.broadcast(deltas), (F.col("pair.printed") == F.col("printed")) & (F.col("pair.seen") == F.col("seen"))).drop("pair", "printed", "seen")

    back = with_deltas(rare, "core", "seen").withColumn("key", F.col("h") - F.col("delta"))
    one = back.join(steady, F.col("key") == F.col("word_h")).withColumns({"steps": F.lit(1), "most": F.col("edits")})
    ahead = with_deltas(steady.where("word_listed and length(word) >= 5"), "word", "printed").select(
        "word", "word_n", "word_listed", (F.col("word_h") + F.col("delta")).alias("met"), F.col("edits").alias("more")
    )
    two = back.where(F.length("core") >= 5).join(ahead, F.col("key") == F.col("met")).withColumns({"steps": F.lit(2), "most": F.col("edits") + F.col("more")})
    cols = ["core", "n", "word", "word_n", "word_listed", "steps", "most"]
    found = one.select(*cols).unionByName(two.select(*cols))
    found = found.where(
        (F.col("core") != F.col("word"))
        & F.levenshtein("core", "word").between(F.col("steps"), F.col("most"))
        & (F.col("word_listed") | (F.col("word_n") >= 4 * F.col("n") + 2))
        & ((F.length("word") >= 3) | F.col("word_listed"))
    )
    rank = F.struct((~F.col("word_listed")).cast("int"), "steps", F.levenshtein("core", "word"), -F.col("word_n"), "word")
    return found.groupBy("core").agg(F.min(rank).getField("word").alias("correction"))


def _inner_page_number(text: Column) -> Column:
    return text.rlike(_PAGE_INSIDE) | (F.instr(text, "\n") > 0) & text.rlike(_PAGE_LINE)


def template(text: Column) -> Column:
    """A short line with its numbers and codes masked."""
    t = F.regexp_replace(F.trim(text), r"\d+", "9")
    t = F.regexp_replace(t, r"(?<![\p{L}\d])\p{Lu}-9", "A-9")
    return F.lower(F.regexp_replace(t, r"\s+", " "))


def first_lines(blocks: DataFrame) -> DataFrame:
    """doc_id, page, template of the pages that begin with a short line."""
    firsts = blocks.where(
        F.col("text").isNotNull()
        & (F.col("kind").isNull() | ~F.col("kind").isin("heading", "page_number", "footer", "list_item"))
        & (F.length("text") <= 60)
        & ~F.col("text").rlike(r"[.!?。؟！？:]\s*$")
        & ~F.col("text").rlike(_PAGE_ALONE)
        & F.col("text").rlike(r"\p{L}{3}")
    )
    top = blocks.groupBy("doc_id", "page").agg(F.min("block_no").alias("block_no"))
    return firsts.join(top, ["doc_id", "page", "block_no"]).select("doc_id", "page", template(F.col("text")).alias("template"))


def running_headers(blocks: DataFrame, least: int = 3, pure: float = 0.9) -> DataFrame:
    """Templates of the first short line of pages that recur in at least `least` documents, and of whose
    standing as a block of their own at least `pure` is at the head of a page. Both hold at every size."""
    heads = first_lines(blocks).groupBy("template").agg(F.count_distinct("doc_id").alias("docs"), F.count("*").alias("heads")).where(F.col("docs") >= least)
    whole = blocks.where(F.length("text") <= 60).groupBy(template(F.col("text")).alias("template")).agg(F.count("*").alias("total"))
    return heads.join(whole, "template").where(F.col("heads") >= F.col("total") * pure).select("template", "docs")


def repeated_headers(blocks: DataFrame) -> DataFrame:
    """doc_id, template of the first short lines that recur on pages of one document."""
    return first_lines(blocks).groupBy("doc_id", "template").agg(F.count_distinct("page").alias("pages")).where("pages >= 2").select("doc_id", "template")


def _ascii_digits(text: Column) -> Column:
    return F.translate(text, "٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "01234567890123456789")


def counted_pages(blocks: DataFrame, rare: float = 0.004) -> DataFrame:
    """Blocks with their page's own number in running text. A document's numbered pages give the distance
    of page number and page; a number at that distance, standing alone between words that numbers
    seldom stand between (under `rare` of all), is the page's. `blocks`: those of pages read by OCR."""
    text = _ascii_digits(F.col("text"))
    n = F.regexp_extract(text, r"(\d{1,4})", 1).try_cast("int")
    alone = blocks.where(F.col("text").rlike(_PAGE_ALONE)).select("doc_id", (n - F.col("page")).alias("away")).where("away is not null")
    votes = alone.groupBy("doc_id", "away").agg(F.count("*").alias("n"))
    distance = votes.groupBy("doc_id").agg(F.max(F.struct("n", (-F.col("away")).alias("k")))["k"].alias("k"))
    flow = blocks.where((F.col("kind").isNull() | ~F.col("kind").isin("page_number", "footer")) & ~F.col("text").contains("\ufffd"))
    around = r"(\S+)\s+\d{1,3}\s+(\S+)"
    side = lambda i: flow.select(F.explode(F.regexp_extract_all(text, F.lit(around), F.lit(i))).alias("w")).groupBy(F.lower("w").alias("w")).agg(F.count("*").alias("c"))
    left, right = staged(side(1), "number-left"), staged(side(2), "number-right")
    total = left.agg(F.sum("c")).first()[0] or 0
    number = (F.col("page") - F.col("k")).cast("string")
    pattern = F.concat(F.lit(r"(?:(\S+)\s+)?(?<!\S)"), number, F.lit(r"(?!\S)(?:\s+(\S+))?"))
    hit = flow.join(distance, "doc_id").withColumn("t", text).where(F.call_function("regexp_like", F.col("t"), pattern))
    at = lambda i: F.lower(F.call_function("regexp_extract", F.col("t"), pattern, F.lit(i)))
    hit = hit.select("doc_id", "page", "block_no", at(1).alias("l"), at(2).alias("r"))
    hit = hit.join(left.select(F.col("w").alias("l"), F.col("c").alias("cl")), "l", "left").join(right.select(F.col("w").alias("r"), F.col("c").alias("cr")), "r", "left")
    least = max(2.0, rare * total)
    return hit.where((F.coalesce("cl", F.lit(0)) <= least) & (F.coalesce("cr", F.lit(0)) <= least)).select("doc_id", "page", "block_no", F.lit("page_no").alias("noise"))


def _header_pattern(template: Column) -> Column:
    """The pattern of texts that hold a template."""
    t = F.regexp_replace(template, r"([^\p{L}\p{M}\p{N}\s])", r"\\$1")
    for a, b in (("9", r"\d+"), (r"a\-\d+", r"\p{L}\-\d+"), (" ", r"\s+")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return F.concat(F.lit(r"(?iu)(?:^|[\s\p{IsHan}])(?:"), t, F.lit(r")(?=$|[\s\p{IsHan}])"))


_HAN_GRAM = 4


def _keys_of(text: Column) -> Column:
    """The join keys of a text: its words of three letters and more, and its grams of Han characters."""
    low = F.lower(text)
    words = F.regexp_extract_all(low, F.lit(r"([\p{L}\p{M}&&[^\p{IsHan}]]{3,})"), F.lit(1))
    han = F.regexp_replace(low, r"[^\p{IsHan}]+", " ")
    grams = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(han) - _HAN_GRAM + 1)), lambda i: F.substring(han, i, F.lit(_HAN_GRAM))), lambda g: g.rlike(rf"^\p{{IsHan}}{{{_HAN_GRAM}}}$"))
    return F.array_distinct(F.when(low.rlike(r"\p{IsHan}"), F.concat(words, grams)).otherwise(words))


def header_places(blocks: DataFrame, headers: DataFrame) -> DataFrame:
    """doc_id, page, block_no, template, whole: the blocks that are a header (with up to a fifth of its
    characters misread) or contain one. The whole lines meet by template or by any word; texts that contain a header hold its longest word."""
    h = F.col("template")
    short = blocks.where(F.length("text") <= 80).withColumn("own", template(F.col("text")))
    keyed = headers.withColumn("keys", _keys_of(h))
    met = short.select("doc_id", "page", "block_no", "own", F.explode(_keys_of(F.col("own"))).alias("key")).join(keyed.select("template", F.explode("keys").alias("key")), "key")
    near = met.where(F.levenshtein("own", h) * 5 <= F.length(h)).select("doc_id", "page", "block_no", "template", F.lit(True).alias("whole"))
    same = short.join(headers, F.col("own") == h).select("doc_id", "page", "block_no", "template", F.lit(True).alias("whole"))
    longest = F.array_max(F.transform("keys", lambda k: F.struct(F.length(k).alias("n"), k.alias("k"))))["k"]
    anchors = keyed.select("template", longest.alias("key")).where(F.col("key").isNotNull()).withColumn("pattern", _header_pattern(h))
    held = blocks.select("doc_id", "page", "block_no", "text", F.explode(_keys_of(F.col("text"))).alias("key")).join(anchors, "key")
    inside = held.where(F.call_function("regexp_like", F.col("text"), F.col("pattern"))).select("doc_id", "page", "block_no", "template", F.lit(False).alias("whole"))
    return same.unionByName(near).unionByName(inside).groupBy("doc_id", "page", "block_no", "template").agg(F.bool_or("whole").alias("whole"))


def header_regex(template: str) -> str:
    """The pattern of _header_pattern for one template, in Python."""
    t = re.escape(template).replace("9", r"\d+").replace(r"a\-\d+", r"[^\W\d_]\-\d+").replace(r"\ ", r"\s+")
    return rf"(?i)(?:(?<=\s)|(?<=[㐀-鿿])|^){t}(?=$|[\s㐀-鿿])"


def own_headers(blocks: DataFrame, repeated: DataFrame) -> DataFrame:
    """Places of the headers of a block's own document, and blocks that are one that another document repeats."""
    h = F.col("template")
    t = template(F.col("text"))
    near = (F.length("text") <= 80) & (F.levenshtein(t, h) * 5 <= F.length(h))
    own = blocks.join(repeated, "doc_id").withColumn("whole", near).where(F.col("whole") | F.call_function("regexp_like", F.col("text"), _header_pattern(h)))
    same = blocks.where(F.length("text") <= 80).withColumn("template", t).join(repeated.select("template").distinct(), "template", "left_semi").withColumn("whole", F.lit(True))
    cols = ["doc_id", "page", "block_no", "template", "whole"]
    return own.select(*cols).unionByName(same.select(*cols))


def edge_lines(blocks: DataFrame, plan: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The blocks that are or contain a running header or a page number and aren't marked so (doc_id, page,
    block_no, noise), and the places of the headers in them."""
    pages = _ocr_pages(plan)
    scanned = blocks.where(F.col("text").isNotNull()).join(pages, ["doc_id", "page"]).select("doc_id", "page", "block_no", "kind", "text")
    b = staged(scanned, "scan-blocks")
    flow = b.where(F.col("kind").isNull() | ~F.col("kind").isin("page_number", "footer"))
    text = flow.where(F.col("kind").isNull() | (F.col("kind") != "heading"))
    headers, repeated = staged(running_headers(blocks), "headers"), staged(repeated_headers(blocks), "own-headers")
    places = staged(header_places(text, headers.select("template")).unionByName(own_headers(text, repeated.join(headers, "template", "left_anti"))), "header-places")
    head = places.select("doc_id", "page", "block_no").distinct().withColumn("noise", F.lit("header"))
    number = flow.where(F.col("text").rlike(_PAGE_ALONE) | _inner_page_number(F.col("text"))).select("doc_id", "page", "block_no", F.lit("page_no").alias("noise"))
    return head.unionByName(number).unionByName(counted_pages(b)), places


class Scan(NamedTuple):
    """What was found on scanned pages. edits: src, doc_id, page, item_no, a, b, noise, core, half, other_no, correction
    (noise line: a compound over a line end, which is no noise); edges: doc_id, page, block_no, noise; places: those of headers."""

    edits: DataFrame
    edges: DataFrame
    places: DataFrame


def scan_findings(words: DataFrame, blocks: DataFrame, plan: DataFrame, lexicon: DataFrame, looks: Lookalikes, garbling: Garbling) -> Scan:
    tokens, native = scan_tokens(words, blocks, plan, looks, garbling, sorted({w for _, w in list_rows(lexicon)}))
    fixes = staged(misreadings(tokens, native, lexicon), "scan-fixes")
    lex = lexicon.where(F.col("word").isNotNull()).select(F.lower("word").alias("core")).distinct()
    key = ["src", "doc_id", "page", "item_no", "a", "b", "core", "half", "other_no"]
    row = lambda df, noise, fix: df.select(*key, F.lit(noise).alias("noise"), fix.alias("correction"))
    plain = row(tokens.where("mode = 'word'").join(fixes, "core"), "misread", F.col("correction"))
    broken = tokens.where("mode in ('join', 'mark', 'inner')")
    whole = lex.select(F.col("core").alias("whole"), F.lit(True).alias("whole_listed"))
    whole_fix = fixes.select(F.col("core").alias("whole"), F.col("correction").alias("whole_correction"))
    joined = (
        broken.join(fixes, "core", "left")
        .join(lex.withColumn("core_listed", F.lit(True)), "core", "left")
        .join(whole, "whole", "left")
        .join(whole_fix, "whole", "left")
        .na.fill(False, ["core_listed", "whole_listed"])
        .withColumn("good", F.col("core_listed") | F.col("correction").isNotNull())
        .withColumn("own", ~F.col("core_listed") & (F.col("whole_listed") | F.col("whole_correction").contains("-") & F.col("correction").isNull()))
    )
    joined = staged(joined, "scan-joined")
    hyphen = row(joined.where("(mode = 'join' and not own) or (mode = 'mark' and not whole_listed) or (mode = 'inner' and good and not own)"), "hyphen", F.coalesce("correction", "core"))
    wrong = joined.where("correction is not null and not own and (mode <> 'inner' or good)")
    first_ok = F.substring("correction", F.lit(1), F.col("half")) == F.substring("core", F.lit(1), F.col("half"))
    rest = F.length("core") - F.col("half")
    last_ok = F.expr("right(correction, length(core) - half)") == F.expr("right(core, length(core) - half)")
    second = wrong.where((~last_ok | first_ok) & F.col("other_no").isNotNull() & (rest > 0)).withColumn("item_no", F.col("other_no"))
    halves = row(wrong.where(~first_ok), "misread", F.col("correction")).unionByName(row(second, "misread", F.lit(""))).unionByName(row(wrong.where(F.col("other_no").isNull()), "misread", F.col("correction")))
    pairs = tokens.where("mode = 'han_pair'").groupBy(F.col("core").alias("ch"), F.col("whole").alias("to")).agg(F.count("*").alias("hits"))
    totals = tokens.where("mode = 'han'").groupBy(F.col("core").alias("ch")).agg(F.count("*").alias("total"))
    taken = pairs.join(totals, "ch").where("hits >= 0.6 * total").select("ch", "to")
    han = row(tokens.where("mode = 'han_pair'").join(taken, (F.col("core") == F.col("ch")) & (F.col("whole") == F.col("to"))), "misread", F.col("whole"))
    odd = row(tokens.where("mode = 'odd'"), "misread", F.lit(None).cast("string")).unionByName(row(tokens.where("mode = 'second'"), "misread", F.col("whole")))
    compound = row(joined.where("own and mode = 'join'"), "line", F.coalesce("whole_correction", "whole"))  # its own hyphen stays, the line end goes
    edges, places = edge_lines(blocks, plan)
    return Scan(plain.unionByName(halves).unionByName(han).unionByName(odd).unionByName(hyphen).unionByName(compound), edges, places)


def scan_noise(words: DataFrame, blocks: DataFrame, plan: DataFrame, lexicon: DataFrame, looks: Lookalikes, garbling: Garbling) -> DataFrame:
    """src, doc_id, page, item_no, noise: one row per item and kind."""
    found = scan_findings(words, blocks, plan, lexicon, looks, garbling)
    edges = found.edges.select(F.lit("blocks").alias("src"), "doc_id", "page", F.col("block_no").alias("item_no"), "noise")
    return found.edits.where("noise <> 'line'").select("src", "doc_id", "page", "item_no", "noise").unionByName(edges).distinct()


def _like(seen: str, word: str) -> str:
    """A correction in the case of what was read."""
    letters = [c for c in seen if c.isalpha()]
    if len(letters) > 1 and sum(c.isupper() for c in letters) * 2 > len(letters):
        return word.upper()
    return word[:1].upper() + word[1:] if letters and letters[0].isupper() else word


def _mended(text: str, correction: str | None) -> str:
    """A token with its correction in place of its core, or without stray marks where there is none."""
    body = text.strip(_EDGE)
    at = text.find(body)
    core = _like(body, correction) if correction is not None else re.sub(r"[~^*|\\]", "", body)
    return text[:at] + core + text[at + len(body) :]


def mend(text: str, edits: list[tuple[int, int, str, str | None]], headers: list[str]) -> str:
    """A paragraph with its edits (start, end, noise, correction) applied, without the lines and
    stretches that are headers or page numbers, on one line. Overlapping edits: the longest, then the first."""
    out, at = [], 0
    kept: list[tuple[int, int, str, str | None]] = []
    for e in sorted(set(edits), key=lambda e: (e[0] - e[1], e[2] not in ("hyphen", "line"), e[3] is None, e[0], e[3] or "")):
        if all(e[1] <= k[0] or e[0] >= k[1] for k in kept):
            kept.append(e)
    for a, b, noise, fix in sorted(kept):
        out += [text[at:a], _mended(text[a:b], fix)]
        at = b
    t = "".join([*out, text[at:]])
    for h in headers:
        t = re.sub(h, " ", t)
    lines = [x for x in t.split("\n") if not _ALONE.match(x)]
    return " ".join(_PAGES_IN.sub(lambda m: (m[1] or m[2] or "") + " ", " ".join(lines)).split())


def repaired(words: DataFrame, blocks: DataFrame, plan: DataFrame, lexicon: DataFrame, looks: Lookalikes, garbling: Garbling) -> DataFrame:
    """doc_id, page, block_no, text, repaired: the paragraphs of scanned pages, ranked corrections, joined halves and edge lines applied. Blocks that
    are nothing but a header or a page number are left out, as are tables and graphics (no text); headings, footers and page numbers marked as such stay."""
    found = scan_findings(words, blocks, plan, lexicon, looks, garbling)
    keys = ["doc_id", "page", "block_no"]
    edits = found.edits.where("src = 'blocks'").withColumnRenamed("item_no", "block_no").groupBy(*keys).agg(F.collect_list(F.struct("a", "b", "noise", "correction")).alias("edits"))  # bounded by a text's length
    heads = found.places.groupBy(*keys).agg(F.bool_or("whole").alias("gone"), F.collect_set("template").alias("heads"))
    numbers = found.edges.where("noise = 'page_no'").select(*keys).distinct().withColumn("numbered", F.lit(True))
    b = blocks.where(F.col("text").isNotNull()).join(_ocr_pages(plan), ["doc_id", "page"]).select(*keys, "kind", "text")
    b = b.join(edits, keys, "left").join(heads, keys, "left").join(numbers, keys, "left").where(~F.coalesce("gone", F.lit(False)))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            new = []
            for t, e, h, marked in zip(pdf["text"], pdf["edits"], pdf["heads"], pdf["marked"]):
                edits = [(x["a"], x["b"], x["noise"], x["correction"]) for x in e] if e is not None else []
                new.append(t if marked and not edits else mend(t, edits, [header_regex(x) for x in h] if h is not None else []))
            yield pdf[[*keys, "text"]].assign(repaired=pd.Series(new, dtype=object))

    marked = F.coalesce(F.col("kind").isin("page_number", "footer", "heading"), F.lit(False)).alias("marked")
    schema = ", ".join(f"`{k}` {blocks.schema[k].dataType.simpleString()}" for k in keys)
    rows = b.where(~(F.coalesce("numbered", F.lit(False)) & F.col("text").rlike(_PAGE_ALONE))).select(*keys, "text", "edits", "heads", marked)
    return spread(rows, *keys).mapInPandas(run, f"{schema}, text string, repaired string").where(F.length("repaired") > 0)
