"""Problem 5: labels, segments, pages and paragraphs; held-out accuracy of the word model."""

import random

import numpy as np
import pytest

from quirefold.llm import language as lg


@pytest.fixture(scope="module")
def rows(spark, data):
    return sorted({(r["lang"], r["word"]) for r in spark.read.parquet(f"{data}/lexicon.parquet").collect()})


def test_codes():
    assert [lg.two_letter(x) for x in ("EN", "eng", "kk-KZ", "", None, "und", "zho", " ru ", "xx")] == ["en", "en", "kk", None, None, None, "zh", "ru", None]


def test_viterbi_is_the_best_path():
    rng = np.random.default_rng(1)
    for _ in range(30):
        s, cost = rng.normal(size=(5, 3)) * 3, 1.5
        best = max(((a, b, c, d, e) for a in range(3) for b in range(3) for c in range(3) for d in range(3) for e in range(3)), key=lambda p: sum(s[i, k] for i, k in enumerate(p)) - cost * sum(x != y for x, y in zip(p, p[1:])))
        path = lg.viterbi(s, cost)
        value = lambda p: sum(s[i, k] for i, k in enumerate(p)) - cost * sum(x != y for x, y in zip(p, p[1:]))
        assert value(path) == pytest.approx(value(best))


def test_held_out_accuracy(rows):
    random.seed(3)
    shuffled = rows[:]
    random.shuffle(shuffled)
    cut = len(shuffled) * 4 // 5
    model = lg.LanguageModel(shuffled[:cut])
    by = {}
    for lang, word in shuffled[cut:]:
        by.setdefault(lang, []).append(word)
    right = total = 0
    for lang, words in by.items():
        for _ in range(40):  # sentences of six words the model has not seen
            text = " ".join(random.choices(words, k=6))
            right += lg.LANGS[model.sums([text])[0].argmax()] == lang
            total += 1
    assert right / total >= 0.95


def test_segments_and_odd_texts(rows):
    model = lg.LanguageModel(rows)
    text = "The records clerk filed the lease annex. Отдел аренды хранит страховой полис. Школьный совет проверяет акт."
    runs = lg.label_text(model, [text, "", "123 456", "。"])
    assert [(a, lang) for a, _, lang, _ in runs[0]] == [(0, "en"), (41, "ru")]
    assert all(0.5 <= c <= 1 for *_, c in runs[0])
    assert runs[1:] == [[], [], []]


def test_frames(spark, rows):
    model = lg.LanguageModel(rows)
    docs = spark.createDataFrame([(1, "The records clerk filed the annex.", None, "x"), (2, None, "en", "x"), (3, "", "en", "x"), (4, "Отдел аренды хранит страховой полис.", "RU", "x")], "doc_id long, text string, lang string, label string")
    got = {r["doc_id"]: (r["label"], r["main_lang"]) for r in lg.document_languages(docs, model).collect()}
    assert got == {1: (None, "en"), 4: ("ru", "ru")}
    words = spark.createDataFrame(
        [(1, p, i, *x) for i, (p, *x) in enumerate([(0, "records", None), (0, "clerk", None), (1, "архивный", "eng"), (1, "отдел", "eng"), (2, "отдел", "rus+eng"), (3, None, None), (4, "17", None)])], "doc_id long, page int, word_no int, text string, language_profile string"
    )
    cases = {(r["page"], r["lang"]) for r in lg.page_cases(lg.word_pages(words, model, str)).collect()}
    assert cases == {(0, "en"), (1, "ru"), (3, "ru"), (4, "ru")}  # pages without letters take the language of most pages
    blocks = spark.createDataFrame([(1, 0, 0, "The records clerk filed it."), (1, 0, 1, "The lease annex was signed."), (1, 0, 2, "Отдел аренды хранит полис."), (1, 0, 3, None), (1, 0, 4, "12")], "doc_id long, page int, block_no int, text string")
    assert [(r["block_no"], r["lang"]) for r in lg.paragraph_cases(lg.paragraph_languages(blocks, model, str)).collect()] == [(2, "ru")]
    for f in (lg.document_languages(docs.limit(0), model), lg.page_cases(lg.word_pages(words.limit(0), model, str)), lg.paragraph_cases(lg.paragraph_languages(blocks.limit(0), model, str))):
        assert f.count() == 0


def test_words_are_labelled_on_one_path(rows):
    model = lg.LanguageModel(rows)
    scores, letters, at = model.words(["The records clerk filed the annex a", "", "Отдел аренды хранит полис"])
    own = lg.spans_of_words(scores[at[0] : at[1]], letters[at[0] : at[1]])
    assert own[lg.LANGS.index("en")] == own.sum() == 29  # a lone letter goes with its neighbours
    assert not lg.spans_of_words(scores[at[1] : at[2]], letters[at[1] : at[2]]).any()
    assert lg.LANGS[lg.spans_of_words(scores, letters).argmax()] == "en"
