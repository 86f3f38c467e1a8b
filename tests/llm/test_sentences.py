"""Problem 10: spans against written-out cases and invariants."""

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from quirefold.llm.sentences import sentence_spans, sentences


def split(t):
    return [t[a:b] for a, b in sentence_spans(t)]


@pytest.mark.parametrize(
    "text,want",
    [
        ("One. Two! Three?", ["One.", "Two!", "Three?"]),
        ("A. B. Smith and Dr. Jones signed vol. 3, p. 4, etc. They left.", ["A. B. Smith and Dr. Jones signed vol. 3, p. 4, etc.", "They left."]),
        ("The note read: “Return by Friday. Keep it.” As recorded.", ["The note read: “Return by Friday. Keep it.”", "As recorded."]),
        ("«Печать видна?» — спросил регистратор. Да.", ["«Печать видна?» — спросил регистратор.", "Да."]),
        ("Договор № 5 от 2018 г.\nподписан в г. Рудежа. Без него.", ["Договор № 5 от 2018 г.\nподписан в г. Рудежа.", "Без него."]),
        ("Плата 1.5 тыс. руб. за лист, т.е. 197 руб. в месяц. Всё.", ["Плата 1.5 тыс. руб. за лист, т.е. 197 руб. в месяц.", "Всё."]),
        ("租赁部门签署草图，总额376.44千元。登记员说：“请周五退回。副本留下。”谁批准了？", ["租赁部门签署草图，总额376.44千元。", "登记员说：“请周五退回。副本留下。”", "谁批准了？"]),
        ("هل الختم واضح؟ راجع د. الغديري ص. 44 إلخ. انتهى.", ["هل الختم واضح؟", "راجع د. الغديري ص. 44 إلخ.", "انتهى."]),
        ("Heading\n\n1. item one\n\nText here.", ["Heading", "1. item one", "Text here."]),
        ("Signed on 8 September 2016.Before that, tysjach.А. Б. Иванов left.", ["Signed on 8 September 2016.", "Before that, tysjach.", "А. Б. Иванов left."]),
        ("Wait... the second is missing. See desk.example or fig. 3.) were moved.", ["Wait... the second is missing.", "See desk.example or fig. 3.) were moved."]),
        ("№ 295 шарт 10.01.2018 ж. Шұғбұлақ қ. жасалды. Төлем бар.", ["№ 295 шарт 10.01.2018 ж. Шұғбұлақ қ. жасалды.", "Төлем бар."]),
        ("“Never closed. It goes on. And on.", ["“Never closed.", "It goes on.", "And on."]),
    ],
)
def test_cases(text, want):
    assert split(text) == want


@given(st.text(alphabet="aBГ1 .!?“”«»\n。—", max_size=200))
@settings(max_examples=300, deadline=None)
def test_spans_cover_all_but_white_space(text):
    spans = sentence_spans(text)
    assert all(a < b for a, b in spans) and all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
    assert "".join(text[a:b] for a, b in spans).split() == text.split() or "".join("".join(text[a:b] for a, b in spans).split()) == "".join(text.split())


def test_long_text_is_linear():
    assert len(sentence_spans("“Open. " * 20_000)) >= 1
    assert len(sentence_spans("Word one. " * 50_000)) == 50_000


def test_frame_with_odd_rows(spark):
    rows = [(1, "One. Two.", "x"), (2, None, "x"), (3, "", "x"), (4, "  \n ", "x"), (1, "One. Two.", "x"), (None, "Three.", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, start_pos string")
    got = sorted((r["doc_id"] or 0, r["start_pos"], r["end_pos"]) for r in sentences(df).collect())
    assert got == [(0, 0, 6), (1, 0, 4), (1, 0, 4), (1, 5, 9), (1, 5, 9)]
    assert sentences(df.limit(0)).count() == 0


def test_long_quotation_is_one_sentence():
    t = "He said: “" + " ".join(f"Return copy {i} now." for i in range(60)) + "” That was all."
    assert [len(x) for x in split(t)] == [t.index("”") + 1, len("That was all.")]


@given(st.lists(st.sampled_from(["Dr. ", "etc. ", "1.5 ", "A. ", "word ", "Then ", "so. ", "so! ", "“", "” ", "(", ") ", "The end. ", "x" * 300 + " ", "г. "]), max_size=60))
@settings(max_examples=200, deadline=None)
def test_dropping_starts_changes_nothing(parts):
    from quirefold.llm import sentences as m

    def keep_all(ends, back, active, end, gain):
        best, node = max(((s + m._length(end - p), -i) for p, s, i in active))
        ends.append(end)
        back.append(-node)
        active.append((end, best + gain, len(ends) - 1))

    text, fast = "".join(parts), m._step
    got = sentence_spans(text)
    try:
        m._step = keep_all
        assert sentence_spans(text) == got
    finally:
        m._step = fast
