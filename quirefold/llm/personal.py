"""Problem 1: personal information inside free text, found and replaced by typed placeholders.

Bootstrapped contextual extraction. Expressions only propose candidates of four families - mail, number,
address, name - each in forms from strict to loose; the word list only parts capitalised words that may be
names from those that may not. Every candidate has instance nodes (the tokens of a name, the digit shape of
a number, the frame of an address) and pattern nodes (the words beside it, and whether a seed stands beside
it). The seeds are the strict forms: in the first round a form speaks for itself. In each later round Spark scores a pattern by the
instances it holds and an instance by the places it stands in; a form counts as a single sighting then.
What is taken is decided by the two scores together, so a strict form in a place that holds other
things is refused and a loose one in a place that holds identifiers is found. Cells have no words around: for names the cell
is the place, other forms stand by what texts say about them.

Defined results: null and empty texts have no items; items never overlap (the earlier, then the longer
wins, a strict form before a loose one before a name); repeated rows are found again; offsets are code
points, end exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quirefold.llm.encoding import Garbling, fit_garbling
from quirefold.llm.wordlist import listed_words
from quirefold.session import spread, staged

TYPES = ("email", "phone", "id_number", "address", "person")
_DIGITS = str.maketrans("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹０１２３４５６７８９", "0123456789" * 3)
_L = r"A-Za-z0-9À-ɏЀ-ԯ"
_INV = "­​‍⁠﻿"
_BETWEEN = frozenset(" \n\t\r\u00a0,،:：;")
_DIGIT = re.compile(r"\d")
_OTHER_DIGIT = re.compile("[٠-٩۰-۹０-９]")
_ARABIC = re.compile(r"[؀-ۿ]")
_NO_INV = dict.fromkeys(map(ord, _INV))
EMAIL = re.compile(
    rf"(?<![{_L}._+\-])[{_L}](?:[{_L}._%+\-{_INV}]*[{_L}])?\s?(?:@|\(at\)|\[at\])\s?[{_L}][{_L}\-{_INV}]*(?:(?:\.|\s?[\[(]dot[\])]\s?)[{_L}][{_L}\-{_INV}]*)+", re.I
)
_EXT = r"(?:,?\s*(?:ext\.?|доб\.?|ішкі|вн\.?|dax\.?|分机|转|داخلي|داخلی)\s*\d{1,5})?"
PHONE = re.compile(
    r"(?<![\w+/.\-])(?:"
    r"\+\d{1,3}[\s.\-]?\(?\d{2,4}\)?(?:[\s.\-]?\d{2,4}){2,4}|\+\d{1,2}\s\d{3}\s\d{7}|\+\d{10,13}"
    r"|00\s\d{1,3}\s\d{3}\s\d{3}\s\d{4}|8\s\d{3}\s\d{3}\s\d{2}\s\d{2}|8\s?\(\d{3}\)\s?\d{3}-\d{2}-\d{2}|8-\d{3}-\d{3}-\d{2}-\d{2}"
    r"|\(\d{3,4}\)\s?\d{3}-?\d{2}-?\d{2}|\d{3}-\d{4}|\d{3}-\d{2}-\d{2})" + _EXT + r"(?![\d/]|-\d)"
)
_PHONE_HAN = re.compile(PHONE.pattern.replace(r"(?<![\w+/.\-])", r"(?<=[㐀-鿿：])"))
ID_STRICT = re.compile(r"(?<![\w/\-.])(?:\d{3}-\d{2}-\d{4}|\d{6}\s\d{6}|[A-Z]{1,2}\d{7,8})(?![\w/\-]|\.\d)")
_ID_HAN = re.compile(r"(?<=[㐀-鿿：])(?:\d{3}-\d{2}-\d{4}|\d{6}\s\d{6}|[A-Z]{1,2}\d{7,8}|\d{12})(?![\dA-Za-z/\-])")
ID_LONG = re.compile(r"(?<![\w/\-.+])\d{12}(?![\w/\-])")
# Words of street addresses in the languages of the texts.
_N = r"\d{1,4}(?:-?[A-Za-zА-Яа-я](?![A-Za-zА-Яа-я]))?"
_UP = r"[A-ZÀ-ÞĞİŞƏЀ-ЯӘҒҚҢӨҰҮҺ]"
_W = r"[\wʻʼ'’\-]"
# (form, words of which it holds one)
ADDRESS = tuple(
    (re.compile(form), words)
    for form, words in (
        (
            rf"(?:(?:[Ff]lat|[Aa]pt\.?|[Uu]nit)\s\d{{1,4}},\s)?(?<![\w/.\-])\d{{1,4}}(?:-[A-Z])?\s(?:{_UP}{_W}*\s){{1,3}}(?:Road|Street|Lane|Row|Avenue|Drive|Square|Way|Close|Court|Hill|Place)(?!\w)"
        rf"(?:,\s(?:flat|apt\.?|unit)\s\d{{1,4}})?(?:,\s{_UP}[a-z]+(?!\s(?:Road|Street|Lane|Row))(?![\w@]))?",
            ("Road", "Street", "Lane", "Row", "Avenue", "Drive", "Square", "Way", "Close", "Court", "Hill", "Place"),
        ),
        (
            rf"(?:г\.\s{_UP}{_W}+,\s)?(?:ул|пр|пер|просп|наб|бул|пл|ш|проезд)\.?\s{_UP}{_W}*(?:\s{_UP}?{_W}+)?,\s(?:(?:д\.|дом)\s{_N}(?:,\s(?:кв\.|квартира)\s\d{{1,4}})?|\d{{1,4}}(?:-\d{{1,4}})?(?!\d))",
            ("д. ", "дом ", "дом\n", "ул", "пр", "пер", "наб", "бул", "пл", "ш"),
        ),
        (
            rf"(?:{_UP}{_W}+\sқ\.,\s)?{_UP}{_W}*(?:\s{_UP}{_W}*)?\s(?:көшесі|даңғылы|тұйығы|бульвары|алаңы),\s\d{{1,4}}(?:-?[а-яА-Я])?-үй(?:,\s\d{{1,4}}-пәтер)?",
            ("көшесі", "даңғылы", "тұйығы", "бульвары", "алаңы"),
        ),
        (
            rf"(?:{_UP}{_W}+\ssh\.,\s)?{_UP}{_W}*(?:\s{_UP}{_W}*)?\s(?:koʻchasi|shoh\s?koʻchasi|xiyoboni|prospekti),\s\d{{1,4}}(?:-?[a-zA-Z])?-uy(?:,\s\d{{1,4}}-xonadon)?",
            ("koʻchasi", "xiyoboni", "prospekti"),
        ),
        (
            rf"(?:{_UP}{_W}+\s(?:ş\.|şəhəri),\s)?{_UP}{_W}*(?:\s{_UP}{_W}*)?\s(?:küçəsi|küç\.|prospekti|pr\.|döngəsi),?\s(?:ev\s)?\d{{1,4}}(?:[-/]?[A-Za-z])?(?:,?\s(?:mənzil|m\.)\s\d{{1,4}})?",
            ("küç", "prospekti", "pr.", "döngəsi"),
        ),
        (
            r"(?:[؀-ۿ]+(?:\s[؀-ۿ]+)?،\s)?شارع\s[؀-ۿ]+(?:\s[؀-ۿ]+)?\sرقم\s\d{1,4}(?:\sشقة\s\d{1,4})?(?:،\s(?:مدينة\s)?[؀-ۿ]+(?:\s[؀-ۿ]+)?)?",
            ("شارع",),
        ),
        (
            r"(?:(?:شهر\s)?[؀-ۿ‌]+،\s)?(?:خیابان|کوچه|بلوار)\s[؀-ۿ‌]+(?:\s[؀-ۿ‌]+)?\sپلاک\s\d{1,4}(?:\sواحد\s\d{1,4})?",
            ("خیابان", "کوچه", "بلوار"),
        ),
        (
            r"(?:[㐀-鿿]{2,3}(?:市|县|镇|区))?[㐀-鿿]{2,3}(?:路|街|巷|大道)\d{1,4}号(?:\d{1,4}[室房])?",
            ("号",),
        ),
    )
)
# Loose forms: capitalised words with a house number, runs of digits, anything around an at sign.
LOOSE_ADDRESS = re.compile(
    rf"(?<![\w/.\-])(?:\d{{1,4}}(?:-[A-Z])?\s(?:{_UP}{_W}+\s){{0,3}}{_UP}{_W}+(?:,\s{_UP}{_W}+)?"
    rf"|(?:{_UP}{_W}+\s){{0,2}}(?:[^\W\d_]{{2,9}}\.?\s)?{_UP}{_W}+(?:\s[^\W\d_]+)?,\s\d{{1,4}}(?:-[^\W\d_]+)?(?:,\s\d{{1,4}}-[^\W\d_]+)?)(?!\w)"
)
LOOSE_NUMBER = re.compile(r"(?<![\w/.\-+])[A-Z]{0,3}[+(]?\d(?:[\d().\-]| (?=[\d(]))*\d(?![\w/])")
LOOSE_MAIL = re.compile(r"[^\s,;]+\s?(?:@|\(at\)|\[at\])\s?[^\s,;]+", re.I)
_ADDRESS_HEAD = re.compile(r"(?:住址|地址|送至|送到|申请人)")
_LEAD = re.compile(rf"({_UP}{_W}+)\s(?={_UP})")
_INITIAL = rf"{_UP}[{_INV}]?\."
_NAME_WORD = rf"{_UP}(?:[a-zß-ʯа-ӿʻʼ'’{_INV}]+|[A-ZÀ-ÞĞİŞƏЀ-ЯӘҒҚҢӨҰҮҺʻ{_INV}]+(?![a-zа-ӿ]))"
NAME = re.compile(
    rf"(?<![\w.@\-])(?:{_INITIAL}\s?(?:{_INITIAL}\s?)?{_NAME_WORD}|{_NAME_WORD},?\s{_INITIAL}(?:\s?{_INITIAL})?|{_NAME_WORD}\s{_NAME_WORD}(?:\s{_NAME_WORD})?)(?![\w@\-])"
)
_ALONE = re.compile(rf"(?<![\w.@\-]){_NAME_WORD}(?![\w@\-])")
_ARABIC_RUN = re.compile(r"[ء-ي٠-ٯٱ-ە‌ٕٔ]+")
_HAN_RUN = re.compile(r"[㐀-鿿]+")
_WORD = re.compile(r"[^\W\d_]+(?:[ʻʼ'’‌\-][^\W\d_]+)*")
_CELL_PART = re.compile(r"[^;/\n،؛、,]+|[^;/\n]+")
# Words before or suffixes of place names.
_CITY_BEFORE = frozenset("مدينة شهر города городе город of in в из г қ".split())
_CITY_END = "市县镇区村路街"


# A form's weight in the first round, by type: what a candidate of this form is held to be before any place has spoken.
STRICT, BORN, LOOSE, CASED, UNCASED = 0.95, 0.8, 0.03, 0.4, 0.0
_BLANK = "\u0001"


def _plain_digits(text: str) -> str:
    return text if text.isascii() or not _OTHER_DIGIT.search(text) else text.translate(_DIGITS)


def _visible(text: str) -> str:
    return text.translate(_NO_INV)


class Item(NamedTuple):
    """A candidate: place in the text, family, instance nodes, and the weight of its form per type."""

    start: int
    end: int
    family: str
    nodes: list[str]
    forms: dict[str, float]


def _shape(number: str) -> str:
    """The digit shape of a number without its extension: digits as 9, letters as A."""
    core = re.split(r"[^\d\s().+\-]{2,}", number.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), maxsplit=1)[0].strip(" ,.")
    return "A" * (len(number) - len(number.lstrip("ABCDEFGHIJKLMNOPQRSTUVWXYZ"))) + re.sub(r"\s", " ", re.sub(r"\d", "9", core))


def _frame(address: str) -> str:
    """The frame of a loose address: capitalised words as C, numbers as 9, other words as they stand."""
    return re.sub(rf"{_UP}{_W}*", "C", re.sub(r"\d+", "9", address)).replace("\n", " ")


class Finder:
    """Candidates of a text. `listed`: the words of the word list, lower case."""

    def __init__(self, listed: list[str], garbling: Garbling):
        self.garbling = garbling
        self.listed = frozenset(listed)
        self.han = frozenset(w for w in listed if _HAN_RUN.fullmatch(w))
        self.longest = max(map(len, self.han), default=1)
        self.garbled = lru_cache(200_000)(lambda w: not w.isascii() and self.garbling.verdict(w)[0] in ("sure", "lost"))

    def items(self, text: str) -> list[Item]:
        """Candidates that are no names, strict forms first, without overlaps."""
        mail = "@" in text or "at)" in (low := text.lower()) or "at]" in low
        digits = _DIGIT.search(text) is not None
        if not (mail or digits):
            return []
        t = _plain_digits(text)
        out: list[Item] = []

        def add(a: int, b: int, family: str, node: str, forms: dict[str, float]) -> None:
            while b > a and t[b - 1] in " \n.,;":
                b -= 1
            if b > a and all(b <= x.start or a >= x.end for x in out):
                out.append(Item(a, b, family, [node], forms))

        if mail:
            for m in EMAIL.finditer(t):
                add(*m.span(), "mail", "strict", {"email": STRICT})
        if digits:
            for number, m in ((i, m) for i, (form, words) in enumerate(ADDRESS) if any(w in t for w in words) for m in form.finditer(t)):
                a, b = m.span()
                if "㐀" <= t[a] <= "鿿":
                    a = self._han_start(t, a, b)
                elif (first := _LEAD.match(t, a, b)) and self._known(first[1]) and not re.match(r"\S+\s(?:көшесі|даңғылы|koʻchasi|küçəsi)", t[a:b]):
                    a = first.end()
                elif "؀" <= t[a] <= "ۿ":
                    street = re.search("شارع|خیابان|کوچه|بلوار", t[a:b])
                    if street and street.start() and t[a : a + street.start()].strip(" ،").split(" ")[-1] in self.listed:
                        a += street.start()
                add(a, b, "address", f"form {number}", {"address": STRICT})
            for rule in (ID_STRICT, _ID_HAN, _PHONE_HAN, PHONE, ID_LONG):
                for m in rule.finditer(t):
                    a, b = m.span()
                    if m[0].isdigit() and len(m[0]) == 12:
                        born = _born(m[0])  # only identity numbers begin with a date of birth under every label of theirs
                        add(a, b, "number", "born 12" if born else "other 12", {"id_number": BORN if born else LOOSE, "phone": 0.0})
                    elif rule is PHONE or rule is _PHONE_HAN:
                        if m[0].count("(") < m[0].count(")"):
                            b = a + m[0].rindex(")")
                        if re.fullmatch(r"\d{3}-\d{2}-\d{2}", m[0]) and not re.search(r"[^\W\d]\W{0,4}$", t[max(0, a - 6) : a]):
                            continue
                        add(a, b, "number", _shape(t[a:b]), {"phone": STRICT, "id_number": 0.0})
                    else:
                        add(a, b, "number", _shape(m[0]), {"id_number": STRICT, "phone": 0.0})
            for m in LOOSE_NUMBER.finditer(t):
                if m.end() - m.start() > 5 and sum(map(str.isdigit, m[0])) > 5:
                    add(*m.span(), "number", _shape(m[0]), {"phone": LOOSE, "id_number": LOOSE})
            for m in LOOSE_ADDRESS.finditer(t):
                add(*m.span(), "address", _frame(m[0]), {"address": LOOSE})
        if mail:
            for m in LOOSE_MAIL.finditer(t):
                add(*m.span(), "mail", "loose", {"email": LOOSE})
        return out

    def _han_start(self, t: str, a: int, b: int) -> int:
        """The start of a Chinese address inside running text: after a label, else as matched."""
        back = max(0, a - 6)
        m = None
        for m in _ADDRESS_HEAD.finditer(t, back, b):
            pass
        return max(a, m.end()) if m else a

    def _known(self, word: str) -> bool:
        return _visible(word).lower() in self.listed

    def _garbled(self, t: str, a: int, b: int) -> bool:
        """Whether a token that the stretch touches is garbled."""
        while a and not t[a - 1].isspace():
            a -= 1
        while b < len(t) and not t[b].isspace():
            b += 1
        return any(map(self.garbled, t[a:b].split()))

    def names(self, text: str, items: list[Item]) -> list[Item]:
        """Candidate names. Capitalised words alone are candidates as well, of a form that is never taken:
        they tell what else a place holds."""
        t = text
        if items:
            hidden = list(text)
            for x in items:
                if max(x.forms.values()) > LOOSE:
                    hidden[x.start : x.end] = _BLANK * (x.end - x.start)
            t = "".join(hidden)
        spans: list[tuple[int, int, float]] = []
        at = 0
        while m := NAME.search(t, at):
            at = m.end()
            words = [w for w in re.findall(r"[^\W\d_]+(?:[ʻʼ'’][^\W\d_]+)*", _visible(m[0])) if len(w) > 1]
            if len(words) > 1 and all(w.isupper() for w in words) or self._garbled(t, *m.span()):
                continue  # shouted or garbled text
            if words and not any(w.lower() in self.listed for w in words):
                spans.append((*m.span(), CASED))
            elif words and words[0].lower() in self.listed:
                at = m.start() + m[0].index(words[0][0]) + len(words[0])  # the label is no part of a name; look on behind it
        taken = [(a, b) for a, b, _ in spans]
        for m in _ALONE.finditer(t):
            if not self._known(m[0]) and all(m.end() <= a or m.start() >= b for a, b in taken) and not self._garbled(t, *m.span()):
                spans.append((*m.span(), -1.0))
        if _ARABIC.search(t):
            run: list[re.Match] = []
            for m in [*_ARABIC_RUN.finditer(t), None]:
                joined = m is not None and run and t[run[-1].end() : m.start()] in (" ", "\n")
                if m is not None and not self._known(m[0]) and (joined or not run):
                    run.append(m)
                    continue
                if 2 <= len(run) <= 4:
                    spans.append((run[0].start(), run[-1].end(), UNCASED))
                run = [m] if m is not None and not self._known(m[0]) else []
        for m in _HAN_RUN.finditer(t):
            for a, b in self._loose(m[0]):
                if 2 <= b - a <= 3 and m[0][b - 1] not in _CITY_END:
                    spans.append((m.start() + a, m.start() + b, UNCASED))
        out = []
        for a, b, form in sorted(set(spans)):
            core = t[a:b]
            if "㐀" <= core[0] <= "鿿":
                tokens = [core[:1] + "*", core[1:]]
            else:
                tokens = [w.lower() for w in _WORD.findall(_visible(core)) if len(w) > 1]
            if tokens:
                out.append(Item(a, b, "name", tokens, {"person": form}))
        return out

    def beside(self, text: str, t: str, at: Item, items: list[Item]) -> str | None:
        """The family of a strict form next to a name, but for mail; a place word before the name parts them."""
        if self.near(t, at.start, -1) in _CITY_BEFORE:
            return None
        return next((x.family for x in items if x.family != "mail" and max(x.forms.values()) > 0.5 and (0 <= x.start - at.end <= 14 or 0 <= at.start - x.end <= 14)), None)

    def near(self, t: str, at: int, step: int, label: bool = False) -> str:
        """The word beside a place: one token, for Chinese the listed word, or a mark at the edge. A label
        may end in a full stop."""
        if step < 0:
            e = at
            while e and (t[e - 1] in _BETWEEN or label and t[e - 1] == "."):
                e -= 1
            if not e:
                return "^"
            if t[e - 1] == _BLANK:
                return "<item>"
            if "㐀" <= t[e - 1] <= "鿿":
                return next((t[e - n : e] for n in range(min(self.longest, e), 1, -1) if t[e - n : e] in self.han), t[e - 1])
            a = e
            while a and (t[a - 1].isalnum() or t[a - 1] in "ʻʼ'’‌-") and not "㐀" <= t[a - 1] <= "鿿":
                a -= 1
            return re.sub(r"\d", "9", t[a:e].lower()) if a < e else t[e - 1]
        a, n = at, len(t)
        while a < n and t[a] in _BETWEEN:
            a += 1
        if a == n:
            return "$"
        if t[a] == _BLANK:
            return "<item>"
        if "㐀" <= t[a] <= "鿿":
            return next((t[a : a + k] for k in range(min(self.longest, n - a), 1, -1) if t[a : a + k] in self.han), t[a])
        e = a
        while e < n and (t[e].isalnum() or t[e] in "ʻʼ'’‌-") and not "㐀" <= t[e] <= "鿿":
            e += 1
        return re.sub(r"\d", "9", t[a:e].lower()) if a < e else t[a]

    def _loose(self, run: str) -> list[tuple[int, int]]:
        """Stretches of a Chinese run that no listed word of two or more characters covers."""
        out, i, start = [], 0, None
        while i < len(run):
            n = next((n for n in range(min(self.longest, len(run) - i), 1, -1) if run[i : i + n] in self.han), 0)
            if n:
                if start is not None:
                    out.append((start, i))
                    start = None
                i += n
            else:
                if start is None:
                    start = i
                i += 1
        if start is not None:
            out.append((start, len(run)))
        return out


def _born(number: str) -> bool:
    """Whether a number begins with a date (year, month, day in two digits each)."""
    return 1 <= int(number[2:4]) <= 12 and 1 <= int(number[4:6]) <= 31


KEY = ["src", "doc_id", "page", "block_no", "row_no", "col_no"]
_CAND = (
    "src string, doc_id bigint, page int, block_no int, row_no int, col_no int, start_pos int, end_pos int, family string, nodes array<string>, "
    "pii_type string, form double, l string, r string, b string"
)


def _rows(finder: Finder, key: tuple, text: str) -> Iterator[tuple]:
    cell = key[0] == "cells"
    items = finder.items(text)
    t = _plain_digits(text)
    if items:
        hidden = list(t)
        for x in items:
            if max(x.forms.values()) > LOOSE:
                hidden[x.start : x.end] = _BLANK * (x.end - x.start)
        t = "".join(hidden)
    for x in items:
        left = "@cell" if cell else finder.near(t, x.start, -1, True)
        for kind, form in x.forms.items():
            yield *key, x.start, x.end, x.family, x.nodes, kind, form, left, None, None
    parts = [(m.start(), m[0]) for m in re.finditer(r"[^;/\n]+", text)] if cell and not re.search(r"\d/\d", text) else [(0, text)]
    for at, part in parts:
        own = [x._replace(start=max(0, x.start - at), end=x.end - at) for x in items if x.start >= at and x.end <= at + len(part)]
        for x in finder.names(part, own):
            if cell:
                if not part[: x.start].strip() and not part[x.end :].strip():  # a name fills its part of a cell
                    yield *key, at + x.start, at + x.end, "name", x.nodes, "person", x.forms["person"], "@cell cased" if x.forms["person"] else "@cell", None, None
                continue
            yield *key, x.start, x.end, "name", x.nodes, "person", x.forms["person"], finder.near(t, x.start, -1), finder.near(t, x.end, 1), finder.beside(part, t, x, own)


def candidates(texts: DataFrame, listed: list[str], garbling: Garbling) -> DataFrame:
    """Candidates of rows (src, doc_id, page, block_no, row_no, col_no, text), one row per possible type, with
    their instance nodes and the patterns left (l), right (r) and beside (b)."""
    shared = texts.sparkSession.sparkContext.broadcast((listed, garbling))
    cols = [c.split()[0] for c in _CAND.split(", ")]

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = Finder(*shared.value)
        for pdf in batches:
            yield pd.DataFrame([x for *key, text in pdf[[*KEY, "text"]].itertuples(index=False) for x in _rows(finder, tuple(key), text)], columns=cols)

    return spread(texts.where(F.length("text") > 0), "doc_id", "page", "block_no").mapInPandas(find, _CAND)


_MARKS = ("^", "$", "<item>", "@cell", "@cell cased")
_SALTS = 32


def _salted(column: str) -> Column:
    """A salt for the few marks that very many edges share; words have none."""
    return F.when(F.col(column).isin(*_MARKS), F.pmod(F.xxhash64("node"), F.lit(_SALTS)).cast("int")).otherwise(0)


def _odds(p: Column, most: float = 4.0) -> Column:
    p = F.least(F.greatest(p, F.lit(0.001)), F.lit(0.999))
    return F.greatest(F.lit(-most), F.least(F.lit(most), F.log(p / (1 - p))))


def _sum_of(at: DataFrame, column: str) -> DataFrame:
    return at.where(F.col(column).isNotNull()).select("pii_type", F.concat(F.lit(f"{column}|"), column).alias("pattern"), "n", "s")


def scored(found: DataFrame, rounds: int = 3) -> DataFrame:
    """The candidates with `instance`, `place` and `score`, a probability made of the two by their odds.

    An edge is one combination of type, instance node and patterns with its count. An instance is worth the mean of the
    places it stands in and of its form: the form of a name token is one sighting among the others, and tokens are held against
    the best of them; the digit shape of a number and the frame of an address restart at their form with 0.4. A pattern is
    worth the mean of its instances and one more sighting, which says no for names and half for others. Patterns of a place count as their mean, but a name's two sides must both speak for it; a seed beside it does too."""
    edges = staged(
        found.select("pii_type", "family", F.explode("nodes").alias("node"), "l", "r", "b", "form")
        .groupBy("pii_type", "family", "node", "l", "r", "b")
        .agg(F.count("*").alias("n"), F.avg(F.greatest(F.col("form"), F.lit(0.0))).alias("form")),
        "pii-edges",
    )
    node = ["pii_type", "family", "node"]
    start = F.when(F.col("b").isNotNull(), 1.0).otherwise(F.col("form"))

    def levelled(df: DataFrame) -> DataFrame:
        """Scores of name tokens as shares of the best, so that rounds do not wear them down."""
        top = df.where("family = 'name'").agg(F.coalesce(F.max("s"), F.lit(0.0))).scalar()
        return df.withColumn("s", F.when(F.col("family") == "name", F.col("s") / F.greatest(top, F.lit(0.6))).otherwise(F.col("s")))

    instance = edges.groupBy(*node).agg((F.sum(F.col("n") * start) / F.sum("n")).alias("s"), (F.sum(F.col("n") * F.col("form")) / F.sum("n")).alias("f"))
    instance = levelled(staged(instance, "pii-instances"))

    def patterns(instance: DataFrame) -> DataFrame:
        at = edges.join(instance.select(*node, "s"), node)
        both = _sum_of(at, "l").unionByName(_sum_of(at, "r")).unionByName(_sum_of(at, "b"))
        return staged(both.groupBy("pii_type", "pattern").agg(((F.sum(F.col("s") * F.col("n")) + F.when(F.col("pii_type") == "person", 0.0).otherwise(0.5)) / (F.sum("n") + 1)).alias("p")), "pii-patterns")

    def placed(df: DataFrame, pattern: DataFrame) -> DataFrame:
        """Adds `place`, the probability that the patterns of a row give; none where no word stands before a form that is no name."""
        for c in ("l", "r"):
            side = pattern.where(F.col("pattern").startswith(f"{c}|")).select(F.col("pii_type"), F.expr("substring(pattern, 3)").alias(c), F.col("p").alias(f"p{c}"))
            salts = F.when(F.col(c).isin(*_MARKS), F.sequence(F.lit(0), F.lit(_SALTS - 1))).otherwise(F.array(F.lit(0)))
            df = df.withColumn("salt", _salted(c)).join(side.withColumn("salt", F.explode(salts)), ["pii_type", c, "salt"], "left").drop("salt")
        near = pattern.where(F.col("pattern").startswith("b|")).select("pii_type", F.expr("substring(pattern, 3)").alias("b"), F.col("p").alias("pb"))
        df = df.join(F.broadcast(near), ["pii_type", "b"], "left")  # one row per family
        pl, pr = F.coalesce("pl", F.lit(0.0)), F.coalesce("pr", F.lit(0.0))
        word = lambda c: F.coalesce(F.col(c).rlike(r"[\p{L}\p{N}]"), F.lit(False))
        both = 2 * pl * pr / F.greatest(F.lit(1e-9), pl + pr)
        sides = F.when(F.col("r").isNull() | ~word("r"), pl).when(~word("l"), pr).otherwise(both)  # a mark says nothing where a word stands on the other side
        return df.withColumn("place", F.when((word("l") & (F.col("l") != "@cell")) | (F.col("family") == "name"), F.greatest(sides, F.coalesce("pb", F.lit(0.0))))).drop("pl", "pr", "pb")

    pattern = patterns(instance)
    for i in range(rounds):
        seen = placed(edges, pattern)
        worth = seen.groupBy(*node).agg(F.coalesce(F.sum(F.col("n") * F.col("place")), F.lit(0.0)).alias("w"), F.coalesce(F.sum(F.when(F.col("place").isNotNull(), F.col("n"))), F.lit(0)).alias("n"))
        alone = F.col("n") == 0
        value = F.when(F.col("family") == "name", (F.col("f") + F.col("w")) / (1 + F.col("n"))).when(alone, F.col("f")).otherwise(0.4 * F.col("f") + 0.6 * F.col("w") / F.col("n"))
        instance = levelled(staged(instance.select(*node, "f").join(worth, node).select(*node, "f", value.alias("s")), "pii-instances"))
        if i + 1 < rounds:
            pattern = patterns(instance)
    cand = ["pii_type", *KEY, "start_pos", "end_pos"]
    per = (
        found.select(*cand, "family", F.explode("nodes").alias("node"))
        .join(instance.select(*node, "s"), node)
        .groupBy(*cand)
        .agg(F.avg("s").alias("mean"), F.max("s").alias("best"))
    )
    rows = placed(found.where("form >= 0").withColumn("node", F.col("nodes")[0]), pattern).drop("node").join(per, cand)
    name = F.col("family") == "name"
    # in a cell one sure token carries the other
    rows = rows.withColumn("instance", F.when(name & (F.col("src") == "cells"), F.greatest("mean", F.col("best") * 0.75)).otherwise(F.col("mean"))).drop("mean", "best")
    # very many numbers share a shape, so a place must leave a strict form 0.3
    odds = F.when(name, _odds(F.col("instance"))).otherwise(_odds(F.col("instance"), 0.85)) + F.when(F.col("place").isNull(), 0.0).otherwise(_odds(F.col("place")))
    return rows.withColumn("score", 1 / (1 + F.exp(-odds)))


def personal_items(texts: DataFrame, lexicon: DataFrame, rounds: int = 3, least: float = 0.5) -> DataFrame:
    """One row per item: src, keys, start_pos, end_pos, pii_type."""
    found = staged(candidates(texts, listed_words(lexicon), fit_garbling(lexicon)), "pii")
    return chosen(scored(found, rounds), least)


def chosen(rows: DataFrame, least: float = 0.5) -> DataFrame:
    """The candidates of at least this score, the better type of each; a name gives way to what overlaps it."""
    span = [*KEY, "start_pos", "end_pos"]
    best = rows.where(F.col("score") >= least).groupBy(*span, "family").agg(F.max(F.struct("score", "pii_type"))["pii_type"].alias("pii_type"))
    names = best.where("family = 'name'").drop("family")
    others = best.where("family <> 'name'").drop("family")
    o = others.select(*KEY, F.col("start_pos").alias("o_start"), F.col("end_pos").alias("o_end"))
    clear = names.join(o, _same(names, o) & (F.col("start_pos") < F.col("o_end")) & (F.col("end_pos") > F.col("o_start")), "left_anti")
    return others.unionByName(clear).select(*span, "pii_type")


def _same(a: DataFrame, b: DataFrame) -> Column:
    out = F.lit(True)
    for k in KEY:
        out &= a[k].eqNullSafe(b[k])
    return out


def texts_of(blocks: DataFrame, cells: DataFrame) -> DataFrame:
    """Block and cell texts under one key."""
    b = blocks.select(F.lit("blocks").alias("src"), "doc_id", "page", "block_no", F.lit(-1).alias("row_no"), F.lit(-1).alias("col_no"), "text")
    c = cells.select(F.lit("cells").alias("src"), "doc_id", "page", F.col("table_no").alias("block_no"), "row_no", "col_no", "text")
    return b.unionByName(c).where(F.col("text").isNotNull())


def masked(texts: DataFrame, items: DataFrame) -> DataFrame:
    """The texts with every item replaced by [TYPE]; all else stays as written."""
    keys = ["src", "doc_id", "page", "block_no", "row_no", "col_no"]
    spans = items.distinct().groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("start_pos", "end_pos", "pii_type"))).alias("items"))  # bounded by a text's length

    def put(acc, x):
        return F.struct(
            F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["start_pos"] - acc["at"]), F.concat(F.lit("["), F.upper(x["pii_type"]), F.lit("]"))).alias("out"),
            x["end_pos"].alias("at"),
        )

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    joined = texts.join(spans, keys, "left")
    done = F.aggregate("items", start, put)
    whole = F.concat(done["out"], F.substring(F.col("text"), done["at"] + 1, F.length("text")))
    return joined.select(*keys, F.coalesce(whole, F.col("text")).alias("text"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))
