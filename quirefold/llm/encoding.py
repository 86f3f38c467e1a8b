"""Problem 3: words garbled by decoding with the wrong character encoding, and their repair.

Round trips: a word is encoded under the encoding it was wrongly read with and strictly decoded as the
one it was written in, up to three times for nested layers. A chain is accepted when the garbling cost
drops enough. The cost of a word adds the surprise of its letters under character models of the word
list and charges for marks that ordinary words lack. A short word whose cost drops a little is accepted
where the same page has a sure word of the same chain.

Defined results: null and ASCII words are never garbled; a word with a replacement or private-use
character is garbled and has no repair if no chain restores it; ties between chains go to the cheapest
text, then to the chain named first.
"""

from __future__ import annotations

import math
import unicodedata
from collections import Counter, defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.language import SCRIPT_LANGS, script_of
from quirefold.llm.wordlist import BOUND, list_rows
from quirefold.session import staged

# Fixed values: (read as, written as) pairs of the encodings that the languages are met in.
PAIRS = tuple(
    (read, written)
    for written, reads in {
        "utf-8": ("cp1252", "latin-1", "cp1251", "gb18030", "cp1254", "cp1256", "cp866", "koi8-r", "mac-cyrillic", "cp437"),
        "cp1251": ("cp1252", "latin-1", "cp866", "koi8-r", "iso8859-5"),
        "cp866": ("cp1251", "koi8-r", "cp1252", "latin-1"),
        "koi8-r": ("cp1251", "cp866", "cp1252", "latin-1"),
        "iso8859-5": ("cp1251", "cp1252", "latin-1"),
        "cp1256": ("cp1252", "latin-1"),
        "gb18030": ("cp1252", "latin-1"),
        "cp1254": ("cp1252", "latin-1", "cp1251"),
    }.items()
    for read in reads
)
_GENTLE = set(".,;:!?()[]{}\"'«»“”„‘’‹›…–—-‐‑/\\№%&@#*+=<>|_~^·•、。，；：？！（）《》〈〉「」『』【】〔〕￥－‧。،؛؟٪٫٬ʻʼ'$ ‌­​‍⁠﻿  　   ")
DROP, SURE = 3.0, 7.0


def _low(text: str) -> str:
    return text.replace("İ", "i").lower()


Chain = tuple[tuple[str, str], ...]


def _to_bytes(text: str, enc: str) -> bytes | None:
    try:
        return text.encode(enc)
    except UnicodeEncodeError:
        if enc not in ("cp1252", "cp1254", "cp1251", "cp1256"):
            return None
    out = bytearray()  # undefined bytes are often read as the control of the same number
    for ch in text:
        try:
            out += ch.encode(enc)
        except UnicodeEncodeError:
            if 0x80 <= ord(ch) < 0xA0:
                out.append(ord(ch))
            else:
                return None
    return bytes(out)


def _reread(text: str, read: str, written: str) -> str | None:
    raw = _to_bytes(text, read)
    if raw is None:
        return None
    try:
        return raw.decode(written)
    except UnicodeDecodeError as e:
        if written == "utf-8" and read == "gb18030" and e.start >= 3 and e.start >= len(raw) - 3 and e.reason in ("unexpected end of data", "invalid continuation byte"):
            return raw[: e.start].decode("utf-8") + "�"  # the last character lost a byte
        return None


class Garbling:
    """Costs and repairs of words. `words`: (lang, word) rows of the word list."""

    def __init__(self, words: list[tuple[str, str]]):
        self.c3: dict[str, Counter] = defaultdict(Counter)
        self.c2: dict[str, Counter] = defaultdict(Counter)
        self.known = {_low(w) for _, w in words if w}
        for lang, word in words:
            w = f"^^{_low(word or "")}$"
            for i in range(2, len(w)):
                self.c3[lang][w[i - 2 : i + 1]] += 1
                self.c3[lang][w[i - 2 : i]] += 1
                self.c2[lang][w[i - 1 : i + 1]] += 1
                self.c2[lang][w[i - 1]] += 1
                self.c2[lang][w[i] + "#"] += 1
                self.c2[lang]["#"] += 1
        self._cached()

    def _cached(self) -> None:
        self.run_cost = lru_cache(200_000)(self._run_cost)
        self.verdict = lru_cache(500_000)(self._verdict)

    def __getstate__(self):
        return {"c3": dict(self.c3), "c2": dict(self.c2), "known": self.known}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._cached()

    def _run_cost(self, run: str) -> float:
        """Surprise of a run of letters of one script under the best of its languages."""
        s = script_of(run)
        low = _low(run)
        if s is None:
            return 7.0 * len(run)
        if low in self.known:
            return 0.4 * len(run)
        best = 1e9
        for lang in SCRIPT_LANGS[s]:
            c3, c2, cost = self.c3.get(lang, {}), self.c2.get(lang, {}), 0.0
            n = c2.get("#", 1)
            if s == "Han":
                cost = sum(1.0 if c2.get(ch + "#") else 5.5 for ch in low)
            else:
                w = f"^^{low}$"
                for i in range(2, len(w)):
                    p = (
                        0.62 * c3.get(w[i - 2 : i + 1], 0) / max(1, c3.get(w[i - 2 : i], 0))
                        + 0.25 * c2.get(w[i - 1 : i + 1], 0) / max(1, c2.get(w[i - 1], 0))
                        + 0.12 * c2.get(w[i] + "#", 0) / n
                        + 0.0004
                    )
                    cost -= math.log(p)
                cost *= len(low) / (len(low) + 1)
            best = min(best, cost)
        inner = sum(a.islower() and b.isupper() for a, b in zip(run, run[1:]))
        return best + 3.0 * inner + (2.0 if len(run) > 3 and run[0].islower() and run[1:].isupper() else 0.0)

    def cost(self, text: str) -> float:
        total, run, kind = 0.0, "", None
        for ch in text:
            k = script_of(ch) if ch.isalpha() or ch in "ʻʼ'" and run else None
            if ch in "ʻʼ'" and run:
                k = kind
            if k is not None and k == kind:
                run += ch
                continue
            if run:
                total += self.run_cost(run)
                if k is not None:
                    total += 3.0  # the script changes inside a word
            run, kind = (ch, k) if k is not None else ("", None)
            if k is None:
                o = ord(ch)
                if ch in _GENTLE:
                    total += 0.3
                elif ch.isdigit():
                    total += 0.2
                elif ch == "�" or 0xE000 <= o < 0xF900:
                    total += 12.0
                elif unicodedata.category(ch) == "Mn":
                    total += 1.0
                else:
                    total += 7.0
        return total + (self.run_cost(run) if run else 0.0)

    def repairs(self, text: str) -> list[tuple[float, Chain, str]]:
        """Every text that a chain of up to three round trips reaches, with its cost."""
        out, level, seen = [], [((), text)], {text}
        for _ in range(3):
            nxt = []
            for chain, t in level:
                latin = any("A" <= ch <= "z" and ch.isalpha() for ch in t)
                for read, written in PAIRS:
                    if latin and written not in ("utf-8", "cp1254"):
                        continue  # words of the other scripts hold no ASCII letters
                    r = _reread(t, read, written)
                    if r and r not in seen and not r.isspace():
                        seen.add(r)
                        c = (*chain, (read, written))
                        out.append((self.cost(r), c, r))
                        if written == "utf-8" and not r.isascii():
                            nxt.append((c, r))
            level = nxt
        return sorted(out, key=lambda x: (x[0] + 1.5 * len(x[1]), len(x[1])))

    def _verdict(self, text: str) -> tuple[str, str | None, tuple[str, ...]]:
        """('clean'|'sure'|'maybe'|'lost', repaired text, names of the chains it may be)."""
        if text.isascii():
            return "clean", None, ()
        core = _low(text.strip(".,;:!?()[]«»“”„\"'…—–،؛؟。，"))
        if core in self.known:
            lost = False
        else:
            lost = any(ch == "�" or 0xE000 <= ord(ch) < 0xF900 for ch in text)
        if lost and "\ufffd" in text:
            return "lost", None, ()
        own = self.cost(text)
        found = self.repairs(text) if own > 2.0 else []
        good = [x for x in found if own - x[0] - 1.5 * (len(x[1]) - 1) >= DROP and x[0] < 0.65 * own and "�" not in x[2]]
        if good:
            c, chain, r = good[0]
            utf = chain[0][1] == "utf-8" and sum(ch > "" for ch in text) >= 2
            firm = utf or sum(ch.isalpha() for ch in r) > 2 or any(not ch.isalnum() and ch not in _GENTLE for ch in text)
            if own - c >= (DROP if utf else SURE) and firm and (utf or core not in self.known):
                return "sure", r, (_name(chain),)
            return "maybe", r, tuple(_name(x[1]) for x in good)
        if lost or any(ch == "�" for x in found[:1] for ch in x[2] if x[0] < 0.8 * own):
            return "lost", None, ()
        mild = [x for x in found if x[0] < own - 0.4 and len(x[1]) == 1 and x[2].strip(".,;:!?").lower() in self.known]
        if mild:
            return "maybe", mild[0][2], tuple(_name(x[1]) for x in mild)
        return "clean", None, ()

    def restored(self, text: str | None) -> str | None:
        """The text itself, or its repair where that is sure."""
        if text is None or text.isascii():
            return text
        kind, r, _ = self.verdict(text)
        return r if kind == "sure" and r else text


def _name(chain: Chain) -> str:
    """One name for chains whose reading differs only in undefined bytes."""
    return ">".join(f"{'cp1252' if a in ('latin-1', 'cp1254') else a}:{b}" for a, b in chain)


def fit_garbling(lexicon: DataFrame, bound: int = BOUND) -> Garbling:
    """Character models of the whole word list; more than `bound` rows are an error."""
    return Garbling(list_rows(lexicon, bound))


def garbled_words(words: DataFrame, model: Garbling, keys: tuple[str, ...] = ("doc_id", "page", "word_no"), page: tuple[str, ...] = ("doc_id", "page")) -> DataFrame:
    """The keys of every garbled word, its text, the restored text (null where lost) and the chain."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        verdict = shared.value.verdict
        for pdf in batches:
            v = [verdict(t) for t in pdf["text"].tolist()]
            hit = [i for i, x in enumerate(v) if x[0] != "clean"]
            out = pdf.iloc[hit].reset_index(drop=True)
            new = {"kind": [v[i][0] for i in hit], "restored": [v[i][1] for i in hit], "chains": [list(v[i][2]) for i in hit]}
            yield out.assign(**{k: pd.Series(x, dtype=object) for k, x in new.items()})

    schema = ", ".join(f"`{k}` {words.schema[k].dataType.simpleString()}" for k in keys)
    judged = staged(
        words.where(F.col("text").rlike(r"[^\x00-\x7f]")).select(*keys, "text").mapInPandas(judge, f"{schema}, text string, kind string, restored string, chains array<string>"),
        "garbled",
    )
    certain = judged.where("kind <> 'maybe'").select(*keys, "text", "restored", F.when(F.size("chains") > 0, F.col("chains")[0]).alias("chain"))
    seen = judged.where("kind = 'sure'").groupBy(*page).agg(F.collect_set(F.col("chains")[0]).alias("page_chains"))
    near = (
        judged.where("kind = 'maybe'")
        .join(seen, list(page))
        .where(F.arrays_overlap("chains", "page_chains"))
        .select(*keys, "text", "restored", F.array_intersect("chains", "page_chains")[0].alias("chain"))
    )
    return certain.unionByName(near)
