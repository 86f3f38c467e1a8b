"""Problem 1: strict items, scored names, and placeholders."""

import pytest

from quirefold.llm.encoding import Garbling
from quirefold.llm.personal import Finder, masked, personal_items

LISTED = "the applicant residing at asks for a copy contact tel hearing was attended by and office of payment order quoting number personal mail confirmed receipt reply to write or call заявитель проживающий по адресу контакт тел личный номер получатель на слушании присутствовали и مقدم الطلب المقيم في للتواصل هاتف 联系人 电话 申请人 住址 出示 证件".split()


@pytest.fixture(scope="module")
def finder():
    return Finder(LISTED, Garbling([("en", w) for w in LISTED]))


def strict(finder, text):
    """The items that a strict form proposes."""
    return [(x.start, x.end, max(x.forms, key=x.forms.get)) for x in finder.items(text) if max(x.forms.values()) >= 0.5]


@pytest.mark.parametrize(
    "text,kind,item",
    [
        ("write to Nora_Pend@oldquay.example or", "email", "Nora_Pend@oldquay.example"), ("mail c.w (at) post.x.invalid.", "email", "c.w (at) post.x.invalid"), ("to M.L [at] a [dot] test quoting", "email", "M.L [at] a [dot] test"),
        ("致函clara63@post.tasbulaq.test或致电", "email", "clara63@post.tasbulaq.test"), ("tel. +7 (756) 555-24-14.", "phone", "+7 (756) 555-24-14"), ("tel. 8 767 552 41 64", "phone", "8 767 552 41 64"), ("tel. 553-9841", "phone", "553-9841"),
        ("tel. +7 759 5579379 ext. 12.", "phone", "+7 759 5579379 ext. 12"), ("电话(759) 556-2154。", "phone", "(759) 556-2154"), ("هاتف +٧٧٤٢٥٥٠١٦٤٣", "phone", "+٧٧٤٢٥٥٠١٦٤٣"), ("number KB9573928,", "id_number", "KB9573928"),
        ("number 954-96-5264,", "id_number", "954-96-5264"), ("number 670612 992748,", "id_number", "670612 992748"), ("at Flat 5, 36-B Cooper's Row by", "address", "Flat 5, 36-B Cooper's Row"),
        ("адресу: г. Рудинск, ул. Садовая, д. 8, кв. 61,", "address", "г. Рудинск, ул. Садовая, д. 8, кв. 61"), ("住址石桥街3号1室，", "address", "石桥街3号1室"), ("في شارع الغدير رقم 85 شقة 21 نسخة", "address", "شارع الغدير رقم 85 شقة 21"),
        ("манекен Қайың даңғылы, 132-үй, көшірме", "address", "Қайың даңғылы, 132-үй"),
    ],
)
def test_strict(finder, text, kind, item):
    assert [(text[a:b], k) for a, b, k in strict(finder, text)] == [(item, kind)]


@pytest.mark.parametrize("text", ["K-9232/81", "receipt 7713988", "on 2024-11-13", "28.05.2017", "1 225 715,04", "Lindale", "", "12.5"])
def test_no_items(finder, text):
    assert strict(finder, text) == []


def frames(spark, rows):
    t = spark.createDataFrame([(s, 1, 0, i, -1, -1, x, "clash") for i, (s, x) in enumerate(rows)], "src string, doc_id long, page int, block_no int, row_no int, col_no int, text string, score string")
    return t, spark.createDataFrame([("en", w, "base") for w in LISTED], "lang string, word string, source string")


ROWS = [
    ("blocks", "Contact: Nora Pendell, tel. 553-9841."), ("blocks", "The applicant OBERMORE Jasper, residing at 83 Old Quay Road, Dunford, asks for a copy."), ("blocks", "للتواصل: سامر السدراوي، هاتف 551-8018."), ("blocks", "للتواصل: هدى السدراوي، هاتف 551-8019."),
    ("blocks", "联系人：孟子安，电话559-7128。"), ("blocks", "申请人孟若溪住址石桥街3号1室。"), ("blocks", "quoting payment order 831394257325."), ("blocks", "quoting payment order 831012257325."), ("blocks", "quoting payment order 991999999999."),
    ("blocks", "quoting payment order 449999999999."), ("blocks", "Personal number 831012806917, mail x@y.test."), ("cells", "سامر السدراوي"), ("cells", "孟子安"), ("cells", "831012806917"), ("cells", "831399806917"), ("cells", "E. Quilcombe / Owen Haskwick"), ("cells", "Lindale"), ("cells", None), ("cells", ""),
]


def test_scored(spark):
    t, lex = frames(spark, ROWS)
    got = sorted({(r["block_no"], r["pii_type"], (ROWS[r["block_no"]][1])[r["start_pos"] : r["end_pos"]]) for r in personal_items(t, lex).collect()})
    assert got == sorted(
        [
            (0, "person", "Nora Pendell"), (0, "phone", "553-9841"), (1, "person", "OBERMORE Jasper"), (1, "address", "83 Old Quay Road, Dunford"), (2, "person", "سامر السدراوي"), (2, "phone", "551-8018"), (3, "person", "هدى السدراوي"), (3, "phone", "551-8019"),
            (4, "person", "孟子安"), (4, "phone", "559-7128"), (5, "person", "孟若溪"), (5, "address", "石桥街3号1室"), (10, "id_number", "831012806917"), (10, "email", "x@y.test"), (11, "person", "سامر السدراوي"), (12, "person", "孟子安"),
            (13, "id_number", "831012806917"), (15, "person", "E. Quilcombe"), (15, "person", "Owen Haskwick"),
        ]
    )
    assert personal_items(t.limit(0), lex).count() == 0


@pytest.mark.parametrize(
    "text,names",
    [
        ("Заявитель Г. Рубецин, проживающий", ["Г. Рубецин"]), ("Sərtlızadə R. E.", ["Sərtlızadə R. E."]), ("Contact: Dağdəmirli Elçin, tel", ["Dağdəmirli Elçin"]), ("attended by M. Fitch and Edith\nPendridge.", ["M. Fitch", "Edith\nPendridge"]),
        ("ЙНМРНПЮ ЦНПНДЮ", []), ("office of Fenford", []), ("", []),
    ],
)
def test_name_shapes(finder, text, names):
    assert [text[x.start : x.end] for x in finder.names(text, []) if x.forms["person"] >= 0] == names


def test_masked(spark):
    t, lex = frames(spark, ROWS[:2])
    t = t.drop("score")
    got = {r["block_no"]: r["text"] for r in masked(t, personal_items(t, lex)).collect()}
    assert got == {0: "Contact: [PERSON], tel. [PHONE].", 1: "The applicant [PERSON], residing at [ADDRESS], asks for a copy."}


def items_of(spark, rows, extra=()):
    t = spark.createDataFrame([("blocks", i, 0, 0, -1, -1, x) for i, x in enumerate(rows)], "src string, doc_id long, page int, block_no int, row_no int, col_no int, text string")
    lex = spark.createDataFrame([("en", w, "base") for w in [*LISTED, *extra]], "lang string, word string, source string")
    return {(r["pii_type"], rows[r["doc_id"]][r["start_pos"] : r["end_pos"]]) for r in personal_items(t, lex).collect()}


def test_graph_rejects_what_its_place_speaks_against(spark):
    rows = [f"Contact: {n}, tel. 553-98{i:02}." for i, n in enumerate(["Nora Pendell", "Owen Fitchell", "Mabel Quilmore", "Silas Haskell"])]
    rows += [f"office of {n} by the receipt" for n in ["Lindale", "Wesrow", "Brostead", "Dunford", "Kelton"]] + ["office of Fenmore Central by the receipt"]
    rows += ["Contact: Clara Thornwick, by the receipt"]
    got = items_of(spark, rows)
    assert ("person", "Fenmore Central") not in got  # unlisted and capitalised, in a place of towns
    assert {("person", "Nora Pendell"), ("person", "Clara Thornwick"), ("phone", "553-9800")} <= got
    assert not any(k == "person" and v in "Lindale Wesrow Brostead Dunford Kelton" for k, v in got)


def test_graph_finds_what_no_strict_form_shows(spark):
    rows = [f"the applicant tel. {n} receipt" for n in ("553-9841", "+7 (756) 555-24-14", "(759) 556-2154", "8 767 552 41 64", "551-1234", "552-7712", "551-4321", "556-1177", "+7 756 5552414", "00 99 766 556 5477")] + ["the applicant tel. 5539841 receipt"]
    rows += [f"receipt 55{i}1841 of payment" for i in range(12)]
    rows += [f"residing at {i} Old Quay Road, asks" for i in range(30, 42)] + ["residing at 12 Velmore Boulevard, asks", "receipt of 12 September was"]
    rows += [f"quoting payment order 83131225732{i}." for i in range(8)] + ["quoting payment order 831012257325."]
    rows += [f"personal number {i}-96-5264," for i in range(101, 112)] + ["personal number 991399999999,", "personal number 831012806917,"]
    got = items_of(spark, rows)
    assert {("phone", "5539841"), ("address", "12 Velmore Boulevard"), ("id_number", "991399999999"), ("id_number", "831012806917")} <= got
    assert not {v for _, v in got} & {f"55{i}1841" for i in range(12)} and ("address", "12 September") not in got
    assert not any(v.startswith("831312257") or v == "831012257325" for _, v in got)


def test_word_list_is_never_cut(spark):
    from quirefold.llm.wordlist import list_rows

    lex = spark.createDataFrame([("en", f"w{i}", "base") for i in range(5)], "lang string, word string, source string")
    assert len(list_rows(lex, 5)) == 5
    with pytest.raises(ValueError, match="more than 4 rows"):
        list_rows(lex, 4)


def test_hot_place_and_repeated_rows(spark):
    rows = ["Nora Pendell, tel. 553-9841"] * 50 + [None, ""]
    assert items_of(spark, rows) == {("person", "Nora Pendell"), ("phone", "553-9841")}
