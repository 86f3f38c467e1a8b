"""Problem 9: passages of held-out test material inside corpus documents.

One Aho-Corasick automaton holds every window of a few tokens of every case sentence, normalised; each
text is scanned once. Hits are collected per sentence and place; the place is then compared with the
sentence token by token, each token weighted by its rarity among the case sentences, so that numbers
and names decide and shared phrasing does not. A sentence counts from `least` of its weight on. Stock
sentences are left out: those of several cases, those that recur in texts of several other cases, and
those with neither number nor name that recur in texts without anything else of their case. Texts are
counted once, however many documents repeat them.

Defined results: null and empty texts and cases have no leaks; a case without sentences of two words has none;
repeated cases and documents each count; equal places go to the first.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.sentences import sentence_spans
from quirefold.session import spread, staged

WINDOW, HAN_WINDOW, OWNERS, ANCHORS, LEAST = 4, 7, 3, 2, 0.72
_GAP = re.compile(r"[\W_]+")
_HAN = re.compile(r"([㐀-鿿])")
_INVISIBLE = "\u00ad\u200b\u200c\u200d\u2060\ufeff"
_DROPPED = re.compile(f"[{_INVISIBLE}]+")
_PLACE = re.compile(rf"[㐀-鿿]|(?:[^\W_㐀-鿿][{_INVISIBLE}]*)+")
# A capitalised word behind a small one: a name of the case.
_NAME = re.compile(r"(?<=[^\W\d_A-ZÀ-ÞЀ-Я])[,;]?\s+[A-ZÀ-ÞĞİŞƏЀ-ЯӘҒҚҢӨҰҮҺ][^\W\d_]+")
# Digits that scans put for letters.
_AS_LETTER = str.maketrans("0135", "oles")


def normalise(text: str) -> str:
    """Lower case, tokens parted by one space and Han characters as tokens of their own."""
    if text.isascii():
        t = _GAP.sub(" ", text.lower())
    else:
        t = _DROPPED.sub("", text) if _DROPPED.search(text) else text  # a scan is far cheaper than a translation
        t = _GAP.sub(" ", t.replace("İ", "i").lower())
        if _HAN.search(t):
            t = " ".join(_HAN.sub(r" \1 ", t).split())
    return f" {t.strip()} "


def _fold(w: str) -> str:
    """Digits inside words as the letters they resemble."""
    return w.translate(_AS_LETTER) if not w.isdigit() and 0 < sum(c.isdigit() for c in w) * 2 <= len(w) else w


def tokens_of(text: str) -> list[str]:
    return [w if w.isalpha() else _fold(w) for w in normalise(text).split()]


class CaseIndex:
    """Sentences of the cases, their windows and the weights of their tokens."""

    def __init__(self, cases: list[tuple[int, str]]):
        self.sentences: list[tuple[int, list[str]]] = []
        named: set[tuple[int, str]] = set()
        owners: dict[str, set[int]] = defaultdict(set)
        rows = []
        for case, text in cases:
            for a, b in sentence_spans(text):
                toks = tokens_of(text[a:b])
                if len(toks) >= 2:  # one word is no passage
                    owners[" ".join(toks)].add(case)
                    rows.append((case, toks))
                    if _NAME.search(text, a, b):
                        named.add((case, " ".join(toks)))
        self.stock = {k for k, v in owners.items() if len(v) > 1}
        self.plain: list[bool] = []
        seen = set()
        for case, toks in rows:
            key = " ".join(toks)
            if key not in self.stock and (case, key) not in seen:
                seen.add((case, key))
                self.sentences.append((case, toks))
        self.plain = [not any(c.isdigit() for t in toks for c in t) and (case, " ".join(toks)) not in named for case, toks in self.sentences]
        df = Counter(t for _, toks in self.sentences for t in set(toks))
        n = len(self.sentences)
        self.weight = {t: math.log((n + 1) / c) for t, c in df.items()}
        han = [sum(_HAN.match(t) is not None for t in toks) * 2 > len(toks) for _, toks in self.sentences]
        self.size = [min(len(toks), HAN_WINDOW if h else WINDOW) for h, (_, toks) in zip(han, self.sentences)]
        self.total = [sum(self.weight[t] for t in toks) for _, toks in self.sentences]
        self._auto = None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k != "_auto"} | {"_auto": None}

    def automaton(self):
        """Windows that at most OWNERS sentences hold; a sentence with fewer than ANCHORS such windows
        keeps all of its own."""
        if self._auto is None:
            import ahocorasick

            places: dict[str, list[tuple[int, int]]] = defaultdict(list)
            for s, (_, toks) in enumerate(self.sentences):
                for i in range(len(toks) - self.size[s] + 1):
                    places[" " + " ".join(toks[i : i + self.size[s]]) + " "].append((s, i))
            few = Counter(s for at in places.values() if len({x for x, _ in at}) <= OWNERS for s in {x for x, _ in at})
            self.anchors = [min(ANCHORS, few[s]) if few[s] >= ANCHORS else 1 for s in range(len(self.sentences))]
            self._auto = ahocorasick.Automaton()
            for key, at in places.items():
                keep = at if len({x for x, _ in at}) <= OWNERS else [x for x in at if few[x[0]] < ANCHORS]
                if keep:
                    self._auto.add_word(key, tuple(keep))
            if len(self._auto):
                self._auto.make_automaton()
        return self._auto

    def score(self, s: int, own: list[str], at: int) -> tuple[float, int, int]:
        """Weighted share of sentence `s` that the tokens around `at` hold in its order (the heaviest
        common subsequence), and the first and last of those tokens."""
        toks, w = self.sentences[s][1], self.weight
        lo, hi = max(0, at - 4), min(len(own), at + len(toks) + 6)
        part = [u if u.isalpha() else _fold(u) for u in own[lo:hi]]
        table = [[0.0] * (len(part) + 1)]
        for t in toks:
            prev, cur, left, g, n = table[-1], [0.0], 0.0, w[t], len(t)
            inexact = n > 3 and not t.isdigit()
            for j, u in enumerate(part):
                v = prev[j + 1] if prev[j + 1] > left else left
                if (t == u or inexact and -2 < n - len(u) < 2 and _near(t, u)) and prev[j] + g > v:
                    v = prev[j] + g
                cur.append(v)
                left = v
            table.append(cur)
        i, j, used = len(toks), len(part), []
        while i and j:
            if table[i][j] == table[i - 1][j]:
                i -= 1
            elif table[i][j] == table[i][j - 1]:
                j -= 1
            else:
                i, j = i - 1, j - 1
                used.append(lo + j)
        return table[-1][-1] / (self.total[s] or 1.0), (used[-1] if used else lo), (used[0] if used else lo)


def _near(a: str, b: str) -> bool:
    """Words (not numbers) of more than three letters that differ by one character."""
    if len(a) < 4 or abs(len(a) - len(b)) > 1 or a.isdigit() or b.isdigit():
        return False
    i, n = 0, min(len(a), len(b))
    while i < n and a[i] == b[i]:
        i += 1
    if len(a) == len(b):
        return a[i + 1 :] == b[i + 1 :]
    return a[i + 1 :] == b[i:] if len(a) > len(b) else a[i:] == b[i + 1 :]


def leaks_in(index: CaseIndex, text: str, least: float = LEAST) -> list[tuple[int, float, int, int]]:
    """(sentence, score, start, end) of every place of every case sentence found, with offsets in `text`."""
    auto = index.automaton()
    if not len(auto):
        return []
    t = normalise(text)
    hits: dict[int, list[int]] = {}
    n = at = 0
    for end, places in auto.iter(t):
        n += t.count(" ", at, end)
        at = end
        for s, i in places:
            hits.setdefault(s, []).append(n - index.size[s] - i)
    if not hits:
        return []
    own: list[str] = []
    spots: list[tuple[int, int]] = []
    out = []
    for s, starts in sorted(hits.items()):
        starts.sort()
        groups: list[list[int]] = []
        for x in starts:
            if groups and x - groups[-1][-1] <= 6:
                groups[-1].append(x)
            else:
                groups.append([x])
        taken = -1
        for g in groups:
            if len(g) < index.anchors[s]:
                continue
            own = own or t.split()
            score, a, b = index.score(s, own, g[len(g) // 2])
            if score >= least and a > taken:
                taken = b
                spots = spots or [m.span() for m in _PLACE.finditer(text.replace("İ", "i"))]
                out.append((s, score, spots[min(a, len(spots) - 1)][0], spots[min(b, len(spots) - 1)][1]))
    return out


def index_cases(cases: DataFrame, bound: int = 100_000) -> CaseIndex:
    """The index of the whole test material, sent to every executor: about 20 KB a case. More than `bound`
    cases are an error, never a cut; splitting them would change which sentences are stock."""
    rows = cases.where(F.length("expected_text") > 0).select("case_id", "expected_text").limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"more than {bound} cases: raise `bound` where executors have the memory")
    return CaseIndex(sorted((r[0], r[1]) for r in rows))


def leaked_sentences(docs: DataFrame, index: CaseIndex, least: float = LEAST) -> DataFrame:
    """doc_id, case_id, sentence_no, score, start_pos, end_pos of the case sentences that documents
    hold, without stock sentences. A text is related to a case by another sentence of it; a sentence with
    a number or name relates its text to the case by itself. Stock is a sentence of several cases; one
    that texts of three other cases hold (texts with sentences of those) and more of them than related
    texts; and one with neither number nor name of whose texts under a fifth are related. Equal texts count once."""
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ix = shared.value
        for pdf in batches:
            rows = []
            for k, t in zip(pdf["doc_id"].tolist(), pdf["text"].tolist()):
                found = leaks_in(ix, t, least)
                if not found:
                    continue
                digest = hashlib.md5(normalise(t).encode("utf-8", "surrogatepass")).hexdigest()
                distinct = {s for s, *_ in found}
                per = Counter(ix.sentences[s][0] for s in distinct)
                marked = Counter(ix.sentences[s][0] for s in distinct if not ix.plain[s])
                for s, sc, a, b in found:
                    case = ix.sentences[s][0]
                    other = min((c for c, n in marked.items() if c != case and n > 1), default=None) if per[case] == 1 else None
                    rows.append((k, case, s, sc, a, b, per[case] > 1, ix.plain[s], digest, other))
            yield pd.DataFrame(rows, columns=["doc_id", "case_id", "sentence_no", "score", "start_pos", "end_pos", "company", "plain", "digest", "other"]).astype({"other": "Int64"})

    found = staged(
        spread(docs.where(F.length("text") > 0).select("doc_id", "text"), "doc_id").mapInPandas(
            scan, "doc_id bigint, case_id bigint, sentence_no int, score double, start_pos int, end_pos int, company boolean, plain boolean, digest string, other bigint"
        ),
        "leaks",
    )
    texts = found.select("sentence_no", "digest", "company", "plain", "other").distinct()
    seen = texts.groupBy("sentence_no").agg(
        F.count("*").alias("n"), F.count_if("company").alias("m"), F.bool_or("plain").alias("plain"), F.count("other").alias("apart"), F.count_distinct("other").alias("others")
    )
    stock = seen.where("(plain and m < 0.2 * n) or (others >= 3 and apart > m)").select("sentence_no")
    return found.join(stock, "sentence_no", "left_anti").drop("company", "plain", "digest", "other")
