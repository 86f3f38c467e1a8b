"""Problem 4: text that looks the same but differs in its characters, brought to one form.

A weighted edit automaton walks tries of the word list with the token as it stands: a look-alike letter, a
compatibility form, another hyphen and an ignorable character are edges that cost nothing, any other edit costs 1, and the bound is
below 1, so a walk ends only at words that look the same. Its word is the canonical spelling; of several, the one that changes fewest letters. A token
that no walk ends is normalised by table: invisible characters go, spaces and hyphens become ordinary,
full-width letters and digits, presentation forms, radicals and ligatures fold, letters compose, and the
letters of the minority script are replaced by their look-alikes in the majority script.

Defined results: null and ASCII text is consistent; a soft hyphen or a not sign at the end of a token is
a broken word (problem 2) and stays; garbled words (problem 3) stay.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.encoding import Garbling
from quirefold.llm.language import script_of
from quirefold.llm.wordlist import BOUND, list_rows

# Letters that look alike, one class per string; upper and lower case apart.
LOOKALIKES = (
    "aаα", "cсϲ", "eеℯ", "oоοօ", "pрρ", "xхχ", "yуγү", "iіι", "jјϳ", "sѕ", "hһ", "kкκ", "vνѵ", "uυ", "nո", "dԁ", "qԛ", "wԝ", "gɡ", "əә", "çҫ", "öӧ", "üӱ", "äӓ", "ëё",
    "tт", "mм", "ıι", "wω", "вʙ", "нʜ",
    "AАΑ", "BВΒ", "CСϹ", "EЕΕ", "HНΗ", "IІΙ", "JЈ", "KКΚ", "MМΜ", "NΝ", "OОΟ", "PРΡ", "SЅ", "TТΤ", "XХΧ", "YУΥҮ", "ZΖ", "ƏӘ", "ÇҪ", "ÖӦ", "ËЁ", "ГΓ", "ПΠ", "ФΦ",
    "يیى", "كک", "هہە", "ʻ‘’ʼ`´ʹ'",
)
INVISIBLE = "\u200b\u200d\u2060\ufeff\u00ad\u200e\u200f\u202a\u202b\u202c\u202d\u202e\u2066\u2067\u2068\u2069\u180e\u2061\u2062\u2063\u2064\u034f"
SPACES = "\u00a0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u202f\u205f\u3000\t"
HYPHENS = "\u2010\u2011\u2043\ufe63\u2212\uff0d"
ZWNJ = "\u200c"
_STRIP = str.maketrans("", "", INVISIBLE)
_SPACE = str.maketrans(dict.fromkeys(SPACES, " "))
_HYPHEN = str.maketrans(dict.fromkeys(HYPHENS, "-"))
_ODD = re.compile(f"[{re.escape(INVISIBLE + SPACES + HYPHENS + ZWNJ)}]")
_FULL = {chr(c): chr(c - 0xFEE0) for c in range(0xFF10, 0xFF5B) if chr(c - 0xFEE0).isalnum()}
_FULL_MARKS = {chr(c): chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)}
_HAN = re.compile(r"[㐀-鿿]")
_GARBLED = re.compile("[\u0080-\u009f\u00a1-\u00ac\u00ae-\u00ff\ufffd]")
_HAN_PARTS = re.compile(r"[㐀-鿿]+|[^㐀-鿿]+")

_EDGES = re.compile(r"^([^\w]*)(.*?)([^\w]*)$", re.S)
_FOLDED = re.compile("[\u2e80-\uffff]")

SAME: dict[str, str] = {}
for _class in LOOKALIKES:
    for _ch in _class:
        SAME[_ch] = SAME.get(_ch, "") + _class


def _accept(ch: str) -> str:
    """The lower-case letters that `ch` may stand for at no cost, its own first."""
    own = "i" if ch == "İ" else ch.lower()
    if ch == "I":
        own += "ı"
    return "".join(dict.fromkeys(own + "".join(x.lower() for x in SAME.get(ch, "") if len(x.lower()) == 1)))


def _table(ch: str) -> str:
    """Compatibility forms that are never regular in this project's texts."""
    o = ord(ch)
    if ch in _FULL:
        return _FULL[ch]
    if 0xFB00 <= o <= 0xFB06 or 0xFB50 <= o <= 0xFDFF or 0xFE70 <= o <= 0xFEFC or 0x2F00 <= o <= 0x2FDF or 0xF900 <= o <= 0xFAFF or 0x1D400 <= o <= 0x1D7FF:
        return unicodedata.normalize("NFKC", ch)
    return ch


class Lookalikes:
    """Tries of the word list by one walk for all languages, and the canonical form of tokens."""

    def __init__(self, words: list[tuple[str, str]]):
        self.words = sorted({w for _, w in words if w})
        self._build()

    def _build(self) -> None:
        self.trie: dict = {}
        for w in self.words:
            node = self.trie
            for ch in unicodedata.normalize("NFC", w.lower()):
                node = node.setdefault(ch, {})
            node[""] = w
        self.token = lru_cache(500_000)(self._token)

    def __getstate__(self):
        return {"words": self.words}

    def __setstate__(self, state):
        self.words = state["words"]
        self._build()

    def walk(self, core: str) -> str | None:
        """The spelling of the vocabulary word that looks like `core`, with its case; None without one."""
        states: list[tuple[dict, int, str]] = [(self.trie, 0, "")]
        for ch in core if core.isalpha() and not _FOLDED.search(core) else "".join(x if x < "\u2e80" and x not in HYPHENS and x not in "ﬀﬁﬂﬃﬄ" else "-" if x in HYPHENS else _table(x) for x in core):
            if ch in INVISIBLE:
                continue
            nxt = []
            options = _accept(ch)
            for node, changed, text in states:
                for k, c in enumerate(options):
                    child = node.get(c)
                    if child is not None:
                        own = k == 0 or c == ch or ch == "I" and c == "ı"
                        nxt.append((child, changed + (not own), text + (ch if own else c.upper() if ch.isupper() else c)))
                if ch == ZWNJ and ZWNJ not in node:
                    nxt.append((node, changed + 1, text))
            states = nxt
            if not states:
                return None
        ends = [(changed, text) for node, changed, text in states if "" in node]
        return min(ends)[1] if ends else None

    def _majority(self, part: str) -> str:
        """The letters of the minority script as look-alikes of the majority script."""
        count: Counter = Counter()
        sure: Counter = Counter()
        for ch in part:
            if script_of(ch) or 0x370 <= ord(ch) < 0x400:
                s = "Greek" if 0x370 <= ord(ch) < 0x400 else script_of(ch)
                count[s] += 1
                sure[s] += not any(script_of(x) != s for x in SAME.get(ch, ch) if x.isalpha())
        if len(count) < 2:
            return part
        main = max(count, key=lambda s: (sure[s] > 0, count[s], s == "Cyrillic"))
        out = []
        for ch in part:
            if script_of(ch) not in (None, main) or 0x370 <= ord(ch) < 0x400:
                ch = next((x for x in SAME.get(ch, "") if x != ch and x.isalpha() and not 0x370 <= ord(x) < 0x400 and script_of(x) == main and x.isupper() == ch.isupper()), ch)
            out.append(ch)
        return "".join(out)

    def _edge(self, marks: str, core: str) -> str:
        """The marks beside a word, by table."""
        if marks.isascii():
            return marks
        marks = marks.translate(_STRIP).translate(_HYPHEN).replace(ZWNJ, "")
        wide = any(ch in _FULL for ch in core) and not _HAN.search(core)
        return "".join(_FULL_MARKS.get(ch, ch) if wide else _table(ch) for ch in marks)

    def _token(self, t: str) -> str:
        """The consistent form of a text without ordinary spaces."""
        if t.isascii():
            return t
        tail = ""
        while t and t[-1] in "\u00ad\u00ac":
            t, tail = t[:-1], t[-1] + tail
        t = unicodedata.normalize("NFC", t.translate(_SPACE).strip(" "))
        left, core, right = _EDGES.match(t).groups()
        if sum(map(str.isalpha, core)) > 1 and not core.isascii() and (word := self.walk(core)) is not None:  # ignorables and compatibility forms are free edges
            if word == core and t.isalpha():
                return t + tail
            return self._edge(left, core) + word + self._edge(right, core) + tail
        t = t.translate(_STRIP).translate(_HYPHEN)
        if any(ord(ch) > 0x2EFF or ch in "ﬀﬁﬂﬃﬄ" for ch in t):
            wide = any(ch in _FULL for ch in t) and not _HAN.search(t)  # its marks are full-width forms as well
            t = "".join(_FULL_MARKS.get(ch, ch) if wide else _table(ch) for ch in t)
        t = unicodedata.normalize("NFC", t)
        if t.isascii():
            return t + tail
        if ZWNJ in t:
            t = re.sub(f"{ZWNJ}(?![؀-ۿ])|(?<![؀-ۿ]){ZWNJ}", "", t)
        left, core, right = _EDGES.match(t).groups()
        if not core:
            return t + tail
        word = core if sum(map(str.isalpha, core)) < 2 else self.walk(core)  # a lone letter has no own script
        if word is None and "-" in core:
            word = "-".join((len(p) > 1 and self.walk(p)) or self._majority(p) for p in core.split("-"))
        if word is None and right[:1] in ("ʻ", "‘", "’", "ʼ"):
            word = self.walk(core + right[0])
            right = right[1:] if word else right
        return left + (word if word is not None else self._majority(core)) + right + tail

    def text(self, t: str | None) -> str | None:
        """The consistent form of a whole text."""
        if t is None or t.isascii():
            return t
        t = t.translate(_SPACE)
        return " ".join(self.token(p) for p in t.split(" ")) if " " in t else self.token(t)


def fit_lookalikes(lexicon: DataFrame, bound: int = BOUND) -> Lookalikes:
    """Tries of the whole word list; more than `bound` rows are an error."""
    return Lookalikes(list_rows(lexicon, bound))


def _is_case(model: Lookalikes, garbling: Garbling) -> Callable[[str], bool]:
    def token(t: str) -> bool:
        if t.isascii():
            return False
        c = model.token(t)
        if c == t:
            return False
        kind = garbling.verdict(t)[0]
        if kind in ("sure", "lost"):
            return False
        return kind == "clean" or _ODD.search(t) is not None or garbling.cost(c) < 0.8 * garbling.cost(t)

    return lru_cache(500_000)(token)


def inconsistent(df: DataFrame, keys: list[str], model: Lookalikes, garbling: Garbling) -> DataFrame:
    """The rows whose text isn't in the consistent form: keys, text and canonical text."""
    shared = df.sparkSession.sparkContext.broadcast((model, garbling))

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, g = shared.value
        case = _is_case(m, g)

        def found(t: str) -> bool:
            for p in t.split(" "):
                if len(p) > 8 and not p.isascii() and _HAN.search(p):  # no spaces between words: garbled pieces are judged apart
                    if any(case(x) for x in _HAN_PARTS.findall(p) if not _GARBLED.search(x)):
                        return True
                elif case(p):
                    return True
            return False

        for pdf in batches:
            out = pdf.iloc[[i for i, t in enumerate(pdf["text"].tolist()) if found(t)]].reset_index(drop=True)
            yield out.assign(canonical=pd.Series([m.text(t) for t in out["text"].tolist()], dtype=object))

    schema = ", ".join(f"`{k}` {df.schema[k].dataType.simpleString()}" for k in keys)
    return df.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(*keys, "text").mapInPandas(judge, f"{schema}, text string, canonical string")
