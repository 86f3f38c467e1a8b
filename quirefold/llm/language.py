"""Problem 5: missing or wrong language labels of documents, segments, pages and paragraphs.

Script ranges narrow the candidate languages of a word; among those, a character model fitted on the
word list scores it. Viterbi over the per-word scores labels the text; a switch costs `switch` between
sentences and is impossible inside one, since a segment is a run of whole sentences.

The model is fitted on at most `bound` rows of the word list (parameter of `fit`), in hash order.

Defined results: text without any letter of a known script has no language and gives no row; a null
or unknown label counts as missing; equal scores go to the language named first in LANGS.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quirefold.llm.sentences import sentence_spans
from quirefold.session import spread, staged

LANGS = ("en", "ru", "kk", "uz", "az", "ar", "fa", "zh")
_AT = {k: i for i, k in enumerate(LANGS)}
# The scripts that the languages are written in, and letters that only some of them use.
SCRIPT_LANGS = {"Latin": ("en", "uz", "az"), "Cyrillic": ("ru", "kk"), "Arabic": ("ar", "fa"), "Han": ("zh",)}
OWN_LETTERS = {"kk": "әғқңөұүһі", "az": "əğışçöü", "uz": "ʻ", "fa": "پچژگیک", "ar": "ةيىأإك", "ru": "ёъ"}
CODES = {
    "en": "en", "eng": "en", "english": "en", "ru": "ru", "rus": "ru", "kk": "kk", "kaz": "kk", "uz": "uz", "uzb": "uz", "az": "az", "aze": "az",
    "ar": "ar", "ara": "ar", "fa": "fa", "fas": "fa", "per": "fa", "zh": "zh", "zho": "zh", "chi": "zh", "chi_sim": "zh", "chi_tra": "zh",
}
WORD = re.compile(r"[㐀-鿿]+|[^\W\d_㐀-鿿]+(?:[ʻʼ‘’'‌\-][^\W\d_㐀-鿿]+)*")
_CLIP, _OTHER = 5.0, -6.0


# Mail addresses are in no language.
_CONTACT = re.compile(r"[A-Z0-9][A-Z0-9._+%\-]*\s?(?:@|\(at\)|\[at\])\s?[A-Z0-9\-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Z0-9\-]+)*|\bext\b", re.I | re.A)


def two_letter(code: str | None) -> str | None:
    """The code of a label in any spelling, None for a missing or unknown one."""
    return CODES.get(re.split(r"[-_]", (c := (code or "").strip().lower()), maxsplit=1)[0]) or CODES.get(c)


def script_of(word: str) -> str | None:
    c = word[0]
    for c in word:
        if c.isalpha():
            break
    else:
        return None
    o = ord(c)
    if o < 0x2B0 or 0x1E00 <= o < 0x1F00:
        return "Latin"
    if 0x400 <= o < 0x530:
        return "Cyrillic"
    if 0x600 <= o < 0x780 or 0xFB50 <= o < 0xFE00 or 0xFE70 <= o < 0xFF00:
        return "Arabic"
    if 0x3400 <= o < 0xA000 or 0xF900 <= o < 0xFB00:
        return "Han"
    return None


def _grams(word: str) -> Iterator[str]:
    w = f"^{word}$"
    for n in (1, 2, 3, 4):
        for i in range(len(w) - n + 1):
            yield w[i : i + n]


class _Ids(dict):
    """Row numbers of scored words; an unknown word is scored when it is first asked for."""

    def __init__(self, model: LanguageModel):
        super().__init__()
        self.model = model

    def __missing__(self, word: str) -> int:
        rows = self.model.rows
        rows.append(self.model.score(word))
        if len(self) < 1_000_000:  # beyond that, words of one batch are scored again where they recur
            self[word] = len(rows) - 1
        return len(rows) - 1


class LanguageModel:
    """Log-probabilities of character runs by language, and a cache of word scores (cleared when it
    holds a million words)."""

    def __init__(self, words: list[tuple[str, str]]):
        by: dict[str, Counter] = {k: Counter() for k in LANGS}
        total = dict.fromkeys(LANGS, 0)
        self.known: dict[str, set[str]] = defaultdict(set)
        for lang, word in words:
            if lang in by and word:
                w = word.lower()
                self.known[w].add(lang)
                for g in _grams(w):
                    by[lang][g] += 1
                    total[lang] += 1
        self.by, self.total = by, total
        self._reset()

    def _reset(self) -> None:
        self.rows: list[tuple[float, ...]] = []
        self.short: dict[str, tuple[list[int], list[int]]] = {}  # rows and letters of the words of short texts
        self.ids = _Ids(self)

    def __getstate__(self):
        return {"by": self.by, "total": self.total, "known": self.known}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self._reset()

    def score(self, word: str) -> tuple[float, ...]:
        """One value per language, 0 for the best; all 0 where the word says nothing."""
        s = script_of(word)
        if s is None:
            return (0.0,) * len(LANGS)
        langs = SCRIPT_LANGS[s]
        if len(langs) == 1:
            v = _OTHER * min(3.0, 0.5 + 0.5 * len(word))
            return tuple(0.0 if k in langs else v for k in LANGS)
        w = word.lower()
        raw = {}
        for k in langs:
            c, n, p = self.by[k], self.total[k] + 1.0, 0.0
            grams = list(_grams(w))
            for g in grams:
                p += math.log((c[g] + 0.05) / n)
            p /= max(1.0, len(grams) / (len(w) + 1))
            if own := OWN_LETTERS.get(k):
                p += 1.5 * sum(ch in own for ch in w)
            raw[k] = p + (2.0 if k in self.known.get(w, ()) else 0.0)
        top = max(raw.values())
        weight = 1.0 if len(w) > 1 else 0.2
        return tuple(max(-_CLIP, raw[k] - top) * weight if k in raw else _OTHER * weight for k in LANGS)

    def words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The scores of all words of the texts one below the other, their letters, and where each text's words begin (one more at the end)."""
        if len(self.ids) > 1_000_000 or len(self.rows) > 3_000_000:
            self._reset()
        ids: list[int] = []
        starts, row_of, sizes = [], self.ids.__getitem__, []
        short = self.short
        for t in texts:
            starts.append(len(ids))
            got = short.get(t)
            if got is None:
                found = WORD.findall(t)
                got = [*map(row_of, found)], [*map(len, found)]
                if len(t) < 24 and len(short) < 500_000:
                    short[t] = got
            ids += got[0]
            sizes += got[1]
        rows = np.asarray(self.rows)[np.asarray(ids, dtype=np.int64)] if ids else np.zeros((0, len(LANGS)))
        return rows, np.asarray(sizes, dtype=float), np.asarray([*starts, len(ids)])

    def sums(self, texts: list[str]) -> np.ndarray:
        """Per text, the sum of its words' scores by language."""
        if len(self.ids) > 1_000_000:
            self._reset()
        ids: list[int] = []
        starts, row_of = [], self.ids.__getitem__
        for t in texts:
            starts.append(len(ids))
            ids += map(row_of, WORD.findall(t))
        out = np.zeros((len(texts), len(LANGS)))
        if ids:
            rows = np.asarray(self.rows)[np.asarray(ids)]
            cum = np.vstack([np.zeros(len(LANGS)), np.cumsum(rows, axis=0)])
            at = np.asarray([*starts, len(ids)])
            out = cum[at[1:]] - cum[at[:-1]]
        return out


def fit(lexicon: DataFrame, bound: int = 200_000) -> LanguageModel:
    """Fits on distinct (lang, word) rows, at most `bound` of them in hash order (a documented sample
    bound: the word list of this project has 2,400)."""
    rows = (
        lexicon.where(F.col("lang").isNotNull() & F.col("word").isNotNull())
        .select("lang", "word")
        .distinct()
        .orderBy(F.xxhash64("lang", "word"))
        .limit(bound)
        .collect()
    )
    return LanguageModel(sorted((r[0], r[1]) for r in rows))


def viterbi(scores: np.ndarray, switch: float) -> list[int]:
    """The best language of each unit; between units a switch costs `switch`."""
    n, k = scores.shape
    if n == 1:
        return [int(scores[0].argmax())]
    names = np.flatnonzero((scores == scores.max(axis=1, keepdims=True)).any(axis=0)).tolist()
    if len(names) == 1:  # one language is best everywhere
        return names * n
    rows = scores[:, names].tolist()
    best, back, m = rows[0], [], range(len(names))
    for row in rows[1:]:
        top = max(m, key=best.__getitem__)
        t = best[top] - switch
        frm = [top if t > best[j] else j for j in m]
        best = [(t if t > best[j] else best[j]) + row[j] for j in m]
        back.append(frm)
    j = max(m, key=best.__getitem__)
    out = [j]
    for frm in reversed(back):
        j = frm[j]
        out.append(j)
    return [names[j] for j in reversed(out)]


def spans_of_words(scores: np.ndarray, letters: np.ndarray, switch: float = 6.0) -> np.ndarray:
    """Letters by language of a row of words, each word labelled by the best path over all of them."""
    out = np.zeros(len(LANGS))
    says = scores.any(axis=1)
    if says.any():
        np.add.at(out, viterbi(scores[says], switch), letters[says])
    return out


def _confidence(total: np.ndarray, best: int) -> float:
    rest = np.delete(total, best).max() - total[best]
    return round(1.0 / (1.0 + math.exp(min(50.0, rest))), 4)


def label_text(model: LanguageModel, texts: list[str], switch: float = 6.0) -> list[list[tuple[int, int, str, float]]]:
    """Per text, its runs of sentences in one language: start, characters, language, confidence.
    Texts without letters have none."""
    spans = [sentence_spans(t) for t in texts]
    sums = model.sums([t[a:b] for t, sp in zip(texts, spans) for a, b in sp])
    out, at = [], 0
    for sp in spans:
        rows = sums[at : at + len(sp)]
        at += len(sp)
        if not len(sp) or not rows.any():
            out.append([])
            continue
        path = viterbi(rows, switch)
        runs: list[list] = []
        for j, ((a, b), k) in enumerate(zip(sp, path)):
            if runs and runs[-1][2] == k:
                runs[-1][1] += b - a
                runs[-1][3].append(j)
            else:
                runs.append([a, b - a, k, [j]])
        out.append([(a, n, LANGS[k], _confidence(rows[js].sum(axis=0), k)) for a, n, k, js in runs])
    return out


def document_languages(docs: DataFrame, model: LanguageModel, switch: float = 6.0) -> DataFrame:
    """Per document and run of sentences in one language: run number, start, characters, lang and
    confidence, with the document's label as a two-letter code, its main language (that of most
    characters), its share and the number of languages."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    cols = ["doc_id", "run_no", "start_pos", "n_chars", "lang", "confidence", "label", "main_lang", "main_share", "n_langs"]

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m = shared.value
        for pdf in batches:
            rows = []
            for k, own, runs in zip(pdf["doc_id"].tolist(), pdf["lang"].tolist(), label_text(m, pdf["text"].tolist(), switch)):
                share = Counter()
                for _, n, lang, _ in runs:
                    share[lang] += n
                if runs:
                    main, most = max(share.items(), key=lambda x: (x[1], -_AT[x[0]]))
                    part = most / share.total()
                    rows += [(k, i, a, n, lang, conf, two_letter(own), main, part, len(share)) for i, (a, n, lang, conf) in enumerate(runs)]
            yield pd.DataFrame(rows, columns=cols)

    return spread(docs.where(F.length("text") > 0).select("doc_id", "text", "lang"), "doc_id").mapInPandas(
        label,
        "doc_id bigint, run_no int, start_pos int, n_chars int, lang string, confidence double, label string, main_lang string, main_share double, n_langs int",
    )


def word_pages(words: DataFrame, model: LanguageModel, repair: Callable[[str], str]) -> DataFrame:
    """Per page: its language (the script with most letters, in it the language with most letters of words
    on the best path over the page's words, or over its part where a batch splits a page, then the higher score), confidence, and the languages its words' profiles name; `profiles`
    is empty where every profile is missing. `repair` restores a word before it is scored."""
    shared = words.sparkSession.sparkContext.broadcast((model, repair))
    sums = [f"s_{k}" for k in LANGS] + [f"l_{k}" for k in LANGS]

    def score(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, fix = shared.value
        for pdf in batches:
            pdf = pdf.sort_values(["doc_id", "page", "word_no"], kind="stable")
            rows, letters, at = m.words([fix(t) for t in pdf["text"].tolist()])
            page = pdf.groupby(["doc_id", "page"], sort=False).size()
            ends = at[np.cumsum(page.to_numpy())]
            out = []
            for (d, p), a, b in zip(page.index, [0, *ends[:-1]], ends):
                out.append((d, p, *rows[a:b].sum(axis=0), *spans_of_words(rows[a:b], letters[a:b])))
            yield pd.DataFrame(out, columns=["doc_id", "page", *sums])

    part = spread(words.where(F.col("text").isNotNull()).select("doc_id", "page", "word_no", "text"), "doc_id", "page").mapInPandas(
        score, "doc_id bigint, page int, " + ", ".join(f"{k} double" for k in sums)
    )
    named = words.groupBy("doc_id", "page").agg(F.collect_set("language_profile").alias("profiles"))  # a few codes a page
    page = part.groupBy("doc_id", "page").agg(*[F.sum(k).alias(k) for k in sums])
    script = {k: s for s, ks in SCRIPT_LANGS.items() for k in ks}
    of_script = {s: sum((F.col(f"l_{k}") for k in ks[1:]), F.col(f"l_{ks[0]}")) for s, ks in SCRIPT_LANGS.items()}
    rank = F.array_max(F.array(*[F.struct(of_script[script[k]].alias("a"), F.col(f"l_{k}").alias("b"), F.col(f"s_{k}").alias("c"), F.lit(-_AT[k]).alias("at"), F.lit(k).alias("lang")) for k in LANGS]))
    second = F.sort_array(F.array(*[F.col(f"s_{k}") for k in LANGS]), asc=False)
    some = sum((F.col(f"l_{k}") for k in LANGS[1:]), F.col(f"l_{LANGS[0]}")) > 0
    return named.join(page, ["doc_id", "page"], "left").select(
        "doc_id", "page", "profiles", F.when(some, rank["lang"]).alias("lang"), (1 / (1 + F.exp(-(second[0] - second[1])))).alias("confidence")
    )


def page_cases(pages: DataFrame) -> DataFrame:
    """Pages whose words all lack a profile, or whose profiles don't name the page's language. A page
    without readable words takes the language of most pages of its document."""
    pages = staged(pages, "page-languages")  # read twice below
    codes = F.create_map(*[F.lit(x) for k, v in CODES.items() for x in (k, v)])
    named = F.flatten(F.transform("profiles", lambda p: F.transform(F.split(p, r"\+"), lambda c: F.try_element_at(codes, F.lower(F.trim(c))))))
    doc = pages.where("lang is not null").groupBy("doc_id", "lang").agg(F.count("*").alias("n"))
    doc = doc.groupBy("doc_id").agg(F.max(F.struct("n", "lang"))["lang"].alias("doc_lang"))
    lack = F.size("profiles") == 0
    found = pages.join(doc, "doc_id", "left").withColumn("named", named)
    return found.where((lack & F.coalesce("lang", "doc_lang").isNotNull()) | (~lack & F.col("lang").isNotNull() & ~F.array_contains("named", F.col("lang")))).select(
        "doc_id", "page", F.coalesce("lang", "doc_lang").alias("lang"), "confidence"
    )


def paragraph_cases(paragraphs: DataFrame) -> DataFrame:
    """Paragraphs not in their document's main language, the one of most paragraphs, then of most letters."""
    known = staged(paragraphs.where("lang is not null"), "paragraph-languages")  # read twice below
    per = known.groupBy("doc_id", "lang").agg(F.count("*").alias("n"), F.sum("letters").alias("letters"))
    main = per.groupBy("doc_id").agg(F.max(F.struct("n", "letters", "lang"))["lang"].alias("main_lang"))
    return known.join(main, "doc_id").where("lang <> main_lang").select("doc_id", "page", "block_no", "lang", "confidence")


def paragraph_languages(blocks: DataFrame, model: LanguageModel, repair: Callable[[str], str]) -> DataFrame:
    """Per text block the language with most letters on the best path over its words, its confidence and letters."""
    shared = blocks.sparkSession.sparkContext.broadcast((model, repair))

    def label(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, fix = shared.value
        for pdf in batches:
            texts = [" ".join(fix(w) for w in t.split(" ")) for t in pdf["text"].tolist()]
            texts = [_CONTACT.sub(" ", t) if "@" in t or "at)" in t or "at]" in t or "AT" in t else t for t in texts]
            rows, letters, at = m.words(texts)
            out = []
            for d, p, no, a, b in zip(pdf["doc_id"], pdf["page"], pdf["block_no"], at[:-1], at[1:]):
                own, total = spans_of_words(rows[a:b], letters[a:b]), rows[a:b].sum(axis=0)
                best = max(range(len(LANGS)), key=lambda k: (own[k], total[k], -k)) if own.any() else None
                second = np.sort(total)[-2:]
                out.append((d, p, no, int(letters[a:b].sum()), None if best is None else LANGS[best], float(second[1] - second[0]), 0.0 if best is None else _confidence(total, best)))
            yield pd.DataFrame(out, columns=["doc_id", "page", "block_no", "letters", "lang", "margin", "confidence"])

    return spread(blocks.where(F.col("text").isNotNull()).select("doc_id", "page", "block_no", "text"), "doc_id", "page").mapInPandas(
        label, "doc_id bigint, page int, block_no int, letters int, lang string, margin double, confidence double"
    )
