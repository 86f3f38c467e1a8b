"""Problem 10: sentence boundaries across languages and scripts.

A semi-Markov dynamic programme chooses whole sentence spans of a paragraph. Every closing mark is a node,
decimals, initials and abbreviations included. A span scores by its closing word and mark and the word
that opens what follows (log odds of a boundary, never a veto), by its length (log-normal around an
ordinary sentence, and a charge for very long ones) and by the quotations and brackets that its two ends
would tear apart. The chain of spans with the greatest sum is taken. The programme keeps only starts that
can still win: the length term differs between two starts by a known bound, so a start that trails another by more
is dropped without a change of the result, and the work stays linear however long the paragraph.

Defined results: null or blank text gives no rows; a paragraph without a closing mark (a heading, a
list item) is one sentence; text of any length is read whole, in code points.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.session import spread

PARAGRAPH = re.compile(r"(?:\r?\n| )[^\S\n]*(?:\r?\n| )\s*| \s*")
MARK = re.compile(r"(?:[.!?…]+|[。！？｡؟۔।॥]+)[»”\"’›」』）)\]】]*")
LIST_MARK = re.compile(r"\s*(?:[(（]?(?:\d{1,4}|[ivxlcIVXLC]{2,5})[.)）]|[(（]?[^\W\d_][)）]|[-–—•*·])(?=\s|[^\W\d])")

# Words before a full stop that a name, a number or a term always follows.
NEVER_LAST = frozenset(
    "dr mr mrs ms prof st no nos art arts para paras vol fig figs p pp cf vs e.g i.e approx sec ch eq ed eds gen rev hon capt "
    "д-р проф г-н г-жа акад доц инж ст п пп т тт с стр см ср рис табл гл ул пр просп пер пл д кв корп оф обл р-н пос им т.е "
    "ж қ көш кв бет ғ "
    "taxm qarang koʻch "
    "səh küç təxm məs "
    "ص د أ م ج ق ف".split()
)
# Words with a full stop that may also end a sentence; the next word decides.
SOMETIMES_LAST = frozenset("etc a.m p.m jr sr inc ltd co г гг руб коп тыс млн млрд т.д т.п др пр тг т.б h.k s b m man min إلخ".split())

OPEN, CLOSE = "«“„‹「『（([【", "»”›」』）)]】"
_PAIR = re.compile(r"[«“„‹「『（(\[【»”›」』）)\]】]")
_CLOSES = dict(zip("»”›」』）)]】", ("«", "“„", "‹", "「", "『", "（(", "(（", "[", "【")))
_BOUNDARY, _NEVER = 2.0, -9.0
# Length in characters: a sentence of _USUAL costs nothing, others by their log ratio; from _LONG on each further _LONG costs one.
_USUAL, _SPREAD, _LONG = 80.0, 0.4, 1200
# What it costs to tear a quotation or bracket at either end of a span; less for pairs longer than _FAR characters.
_TORN, _FAR = 3.0, 2000
# The most by which the length term can favour an earlier start over a later one.
_EARLIER = _SPREAD * log((_USUAL + 10) / 10)


def _evidence(t: str, first: int, last: int, mark: int, end: int, stop: int) -> float:
    """Closing word, closing mark and opening word of the node at `end`; `mark` is where its marks
    begin, `last` the node before, which a sentence that lacks its space may touch."""
    k = end
    while k < stop and t[k].isspace():
        k += 1
    if k >= stop:
        return _BOUNDARY
    nxt, spaced = t[k], k > end
    if nxt in ",;:)]»”–—،؛、，；：-/%":
        return _NEVER
    lower = nxt.islower()
    kind = t[mark]
    if kind in "。！？｡۔।॥":
        return _BOUNDARY
    if kind in "!?؟":
        return _NEVER if lower else _BOUNDARY + 1
    if lower or kind == "…" and not spaced:
        return _NEVER
    marks = t[mark:end]
    if marks[-1] not in ".…":  # a quotation or bracket ends with the sentence
        return _BOUNDARY
    w = mark
    while w > last and mark - w < 24 and not t[w - 1].isspace():
        w -= 1
    word = t[w:mark].lstrip("(«“„\"'[")
    if not word:
        return _NEVER if not spaced else _BOUNDARY - 1
    if not spaced:
        if nxt.isdigit():
            return _BOUNDARY - 0.5 if len(word) > 3 and word.isalpha() and word.islower() and word not in NEVER_LAST else _NEVER
        if not nxt.isalpha() and nxt not in OPEN and nxt != "№" or len(word) < 2 or "." in word and not word[-1].isdigit():
            return _NEVER
    low = word.lower()
    if len(word) == 1 and word.isupper():
        return _NEVER  # an initial
    if low in SOMETIMES_LAST:
        if low == "г":
            before = t[first:w].split()[-1:]
            if not before or not before[0][-1:].isdigit():
                return _NEVER
        return _BOUNDARY - 1
    tail = low.rsplit("-", 1)[-1]
    if low in NEVER_LAST or tail in NEVER_LAST and low[:1].isdigit():
        return _NEVER
    if len(word) == 1 and not word.isdigit() and not "㐀" <= word <= "鿿":
        return _NEVER
    if len(word) <= 4 and "." in word and word.replace(".", "").isalpha():
        return _NEVER
    if word.isdigit() and not LIST_MARK.sub("", t[first:mark] + ". a", count=1).strip(" a"):
        return _NEVER  # the number of a list item
    return _BOUNDARY


def _length(n: int) -> float:
    return -_SPREAD * abs(log((n + 10) / (_USUAL + 10))) - (n - _LONG if n > _LONG else 0) / _LONG


def _later(n: int) -> float:
    """The most by which the length term can favour a start that is n characters later."""
    return _SPREAD * log(1 + n / (_USUAL + 10)) + n / _LONG


def _torn(t: str, a: int, b: int) -> list[tuple[int, float]]:
    """(position, change) of the cost of a cut, from the pairs that close inside the paragraph."""
    stack: list[tuple[int, str]] = []
    out = []
    for m in _PAIR.finditer(t, a, b):
        ch = m[0]
        opens = _CLOSES.get(ch, "„" if ch == "“" and any(x == "„" for _, x in stack) else "")
        at = next((i for i in range(len(stack) - 1, -1, -1) if stack[i][1] in opens), None) if opens else None
        if at is not None:
            start = stack[at][0]
            del stack[at:]
            w = _TORN if m.start() - start <= _FAR else _TORN * _FAR / (m.start() - start)
            out += [(start + 1, w), (m.end(), -w)]
        elif ch in OPEN:
            stack.append((m.start(), ch))
    out.sort()
    return out


def sentence_spans(t: str | None) -> list[tuple[int, int]]:
    """[start, end) of every sentence, without surrounding white space."""
    if not t:
        return []
    out, a, n = [], 0, len(t)
    while a < n:
        m = PARAGRAPH.search(t, a)
        b, nxt = (m.start(), m.end()) if m else (n, n)
        if b > a:
            _paragraph(t, a, b, out)
        a = nxt
    return out


def _paragraph(t: str, a: int, b: int, out: list[tuple[int, int]]) -> None:
    while b > a and t[b - 1].isspace():
        b -= 1
    item = LIST_MARK.match(t, a, b)
    from_ = item.end() if item else a
    torn = _torn(t, a, b) if _PAIR.search(t, a, b) else ()
    ends, back = [a], [0]
    active = [(a, 0.0, 0)]  # starts that can still win: position, score, node
    last, cost, k, m_end = from_, 0.0, 0, a
    for m in MARK.finditer(t, from_, b):
        m_end = m.end()
        gain = _evidence(t, from_, last, m.start(), m_end, b)
        if gain > -5:
            last = m_end
        while k < len(torn) and torn[k][0] <= m_end:
            cost += torn[k][1]
            k += 1
        if m_end < b:
            gain -= 2 * cost
            first = active[0][0]
            if gain < -8 and m_end - first < 6000:
                continue  # no start is so far away that the length term could make up for it
            if len(active) == 1 and gain >= _BOUNDARY and m_end - first <= _LONG:
                ends.append(m_end)  # nor so near that another start could still win; with one start left the score is no matter
                back.append(active[0][2])
                active[0] = (m_end, 0.0, len(ends) - 1)
                continue
            _step(ends, back, active, m_end, gain)
    if b > a:
        _step(ends, back, active, b, 1e9)
    cuts, j = [], len(ends) - 1
    while j:
        cuts.append(ends[j])
        j = back[j]
    s = a
    for c in reversed(cuts):
        while s < c and t[s].isspace():
            s += 1
        e = c
        while e > s and t[e - 1].isspace():
            e -= 1
        if e > s:
            out.append((s, e))
        s = c


def _step(ends: list[int], back: list[int], active: list[tuple[int, float, int]], end: int, gain: float) -> None:
    """Adds a node behind the best of the active starts and drops the starts that cannot win any more."""
    best, node = -1e18, 0
    for p, s, i in active:
        v = s + _length(end - p)
        if v > best:
            best, node = v, i
    score = best + gain
    if any(s - score >= _later(end - p) for p, s, _ in active):
        return
    ends.append(end)
    back.append(node)
    active[:] = [x for x in active if score - x[1] < _EARLIER]
    active.append((end, score, len(ends) - 1))


def sentences(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per sentence: the key, start_pos and end_pos. Other columns are not read."""

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ks, ss, es = [], [], []
            for k, t in zip(pdf["k"].tolist(), pdf["t"].tolist()):
                spans = sentence_spans(t)
                ks += [k] * len(spans)
                ss += [x[0] for x in spans]
                es += [x[1] for x in spans]
            yield pd.DataFrame({key: ks, "start_pos": ss, "end_pos": es})

    kind = df.schema[key].dataType.simpleString()
    return spread(df.where(F.length(F.trim(text)) > 0).select(F.col(key).alias("k"), F.col(text).alias("t")), "k").mapInPandas(
        split, f"`{key}` {kind}, start_pos int, end_pos int"
    )
