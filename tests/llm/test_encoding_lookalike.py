"""Problems 3 and 4: exact round trips and one form of characters."""

import pytest

from quirefold.llm.encoding import Garbling, garbled_words
from quirefold.llm.lookalike import Lookalikes, inconsistent


@pytest.fixture(scope="module")
def rows(spark, data):
    return sorted({(r["lang"], r["word"]) for r in spark.read.parquet(f"{data}/lexicon.parquet").collect()})


@pytest.fixture(scope="module")
def garbling(rows):
    return Garbling(rows)


@pytest.fixture(scope="module")
def looks(rows):
    return Lookalikes(rows)


@pytest.mark.parametrize("written,read", [("utf-8", "cp1252"), ("utf-8", "latin-1"), ("utf-8", "cp1251"), ("cp1251", "cp866"), ("cp1251", "koi8-r"), ("koi8-r", "cp1251"), ("cp1251", "latin-1")])
def test_round_trips_of_russian_words(garbling, rows, written, read):
    words = [w for lang, w in rows if lang == "ru" and w.isalpha() and len(w) > 4][:80]
    done = right = 0
    for w in words:
        try:
            bad = w.encode(written).decode(read)
        except UnicodeDecodeError:
            continue
        done += 1
        kind, text, _ = garbling.verdict(bad)
        right += kind == "sure" and text == w
    assert done > 20 and right / done >= 0.95


def test_nested_layers_and_other_scripts(garbling):
    bad = "обзор".encode().decode("latin-1").encode().decode("latin-1")
    assert garbling.verdict(bad)[:2] == ("sure", "обзор")
    assert garbling.verdict("清单".encode("gb18030").decode("latin-1"))[:2] == ("maybe", "清单") or garbling.verdict("清单".encode("gb18030").decode("latin-1"))[1] == "清单"
    assert garbling.verdict("سجل".encode("cp1256").decode("cp1252"))[:2] == ("sure", "سجل")


def test_clean_words_stay_clean(garbling, rows):
    wrong = [w for _, w in rows if garbling.verdict(w)[0] in ("sure", "lost")]
    assert wrong == []
    for w in ("Зорьковцев", "Müddət", "№", "“the”", "می‌کند", "café", ""):
        assert garbling.verdict(w)[0] == "clean"
    assert garbling.verdict("����")[0] == "lost"


def test_page_context_decides_short_words(spark, garbling):
    u = "управление отдел архивный".split()
    rows = [(1, 0, i, w.encode("cp1251").decode("koi8-r"), "x") for i, w in enumerate(u)] + [(1, 0, 8, "на".encode("cp1251").decode("koi8-r"), "x"), (2, 0, 1, "на".encode("cp1251").decode("koi8-r"), "x"), (1, 0, 9, None, "x"), (1, 0, 10, "", "x")]
    df = spark.createDataFrame(rows, "doc_id long, page int, word_no int, text string, kind string")
    got = {(r["doc_id"], r["word_no"]): r["restored"] for r in garbled_words(df, garbling).collect()}
    assert got == {(1, 0): "управление", (1, 1): "отдел", (1, 2): "архивный", (1, 8): "на"}
    assert garbled_words(df.limit(0), garbling).count() == 0


@pytest.mark.parametrize(
    "token,want",
    [
        ("bоʻlimi", "boʻlimi"), ("coвeт", "совет"), ("ｏｆｆｉｃｅ", "office"), ("а​кт", "акт"), ("Müddət", "Müddət"), ("\xa0the", "the"), ("oﬃce", "office"), ("тiзiмін", "тізімін"),
        ("الإیجار", "الإيجار"), ("می‌كند", "می‌کند"), ("cost‐sharing", "cost-sharing"), ("申请⼈", "申请人"), ("Зoрькoвцев", "Зорьковцев"), ("３０１", "301"),
    ],
)
def test_canonical(looks, token, want):
    assert looks.token(token) == want


@pytest.mark.parametrize("token", ["№", "“the”", "می‌کند", "oʻrta", "，", "٣٤", "—", "М-562/98", "C-450/13.", "pro¬", "при­", "IT-отдел", "в", "a", ""])
def test_regular_stays(looks, token):
    assert looks.token(token) == token


def test_frame(spark, looks, garbling):
    df = spark.createDataFrame([(1, "coвeт", "c"), (2, "совет", "c"), (3, None, "c"), (4, "", "c"), (5, "the\xa0office", "c"), (6, "Ð½Ð°Ð¿Ñ€Ð°Ð²Ð»ÑÐµÑ‚", "c"), (1, "coвeт", "c")], "k long, text string, canonical string")
    got = sorted((r["k"], r["canonical"]) for r in inconsistent(df, ["k"], looks, garbling).collect())
    assert got == [(1, "совет"), (1, "совет"), (5, "the office")]
    assert inconsistent(df.limit(0), ["k"], looks, garbling).count() == 0
