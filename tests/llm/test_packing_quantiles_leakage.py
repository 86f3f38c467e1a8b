"""Problems 6, 8 and 9: against brute force."""

import itertools
import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from quirefold.llm import leakage as lk
from quirefold.llm import packing as pk
from quirefold.llm import quantiles as qt


def test_closest_filling_is_best():
    random.seed(2)
    for _ in range(150):
        items = [random.randint(1, 30) for _ in range(random.randint(0, 9))]
        room = random.randint(0, 70)
        counts = {n: items.count(n) for n in items}
        best = max(sum(c) for k in range(len(items) + 1) for c in itertools.combinations(items, k) if sum(c) <= room)
        used = pk.closest(counts, room)
        assert sum(n * c for n, c in used.items()) == best and all(c <= counts[n] for n, c in used.items())


def test_windows_hold_every_item_once():
    random.seed(4)
    lengths = [random.choice([3, 3, 7, 20, 55, 99, 100]) for _ in range(800)]
    boxes = pk.fill_window(lengths, 100)
    assert sorted(n for b, _ in boxes for n in b) == sorted(lengths)
    assert all(sum(b) + s == 100 and s >= 0 for b, s in boxes)
    least = max(math.ceil(sum(lengths) / 100), sum(n > 50 for n in lengths))
    assert len(boxes) <= least * 1.02 + 1
    assert pk.fill_window([], 10) == [] and pk.fill_window([0, 0], 10) == []


def test_containers(spark):
    tokens = spark.createDataFrame([(i, n) for i, n in enumerate([0, 5, 10, 11, 25, 3, 3, 7, 10, 1])] + [(4, 25)], "doc_id long, n_tokens long").withColumn("window", F.lit("clash"))
    sizes = spark.createDataFrame([(1, 10), (2, 64), (3, 0)], "size_id int, capacity_tokens int")
    rows = pk.containers(tokens, sizes, window=4).toPandas()
    for cap, g in rows.groupby("capacity_tokens"):
        assert g.n_tokens.sum() == 100 and (g.groupby("container_id").n_tokens.sum() <= cap).all()
        whole = g[g.doc_id.isin([0, 1, 2, 5, 6, 7, 8, 9])]
        assert (whole.piece_no == 0).all()
    assert (rows[(rows.capacity_tokens == 10) & (rows.doc_id == 3)].n_tokens.sort_values().tolist()) == [1, 10]
    assert pk.containers(tokens.limit(0), sizes).count() == 0
    assert pk.containers(tokens, sizes.limit(0)).count() == 0


def test_codes_keep_order_and_error():
    v = np.array([-np.inf, -1e300, -5.5, -1e-300, 0.0, 1e-300, 1.0, 1.004, 3.7, 1e12, np.inf])
    c = qt.encode(v)
    assert (np.diff(c) >= 0).all() and c.max() < 2**qt.BITS and c.min() >= 0
    x = np.random.default_rng(1).lognormal(0, 5, 5000)
    assert (np.abs(qt.decode(qt.encode(x)) / x - 1) <= 2.0 ** -(qt.MANTISSA + 1) + 1e-12).all()


def test_percentiles_within_bound_and_merge(spark):
    rng = np.random.default_rng(5)
    pdf = pd.DataFrame({"g": rng.choice(["a", "b", None], 30_000), "day": rng.integers(0, 3, 30_000), "v": rng.lognormal(1, 2, 30_000)})
    pdf.loc[::50, "v"] = np.nan
    pdf.loc[::3, "v"] = 2.0  # one value holds a third
    df = spark.createDataFrame(pdf).withColumn("v", F.when(~F.isnan("v"), F.col("v")))
    days = qt.sketches(df, ["g", "day"], F.col("v"))
    whole = {(r["g"], r["cell"]): r["value"] for r in qt.sketches(df, ["g"], F.col("v")).collect()}
    assert {(r["g"], r["cell"]): r["value"] for r in qt.merged(days, ["g"]).collect()} == whole
    for r in qt.percentiles(qt.merged(days, ["g"]), ["g"], (0.0, 0.1, 0.5, 0.9, 0.99, 1.0)).collect():
        own = pdf[(pdf.g.isna() if r["g"] is None else pdf.g == r["g"]) & pdf.v.notna()].v.to_numpy()
        assert r["n"] == len(own)
        lo, hi = (own < r["estimate"] * (1 - r["value_bound"])).mean(), (own <= r["estimate"] * (1 + r["value_bound"])).mean()
        assert lo - r["rank_bound"] <= r["share"] <= hi + r["rank_bound"]


def test_deletions_leave_no_trace(spark):
    df = spark.createDataFrame([("a", float(i % 97), 1) for i in range(500)] + [("a", float(i % 97), -1) for i in range(400)], "g string, v double, w long")
    rest = spark.createDataFrame([("a", float(i % 97), 1) for i in range(400, 500)], "g string, v double, w long")
    cells = lambda x: sorted((r["cell"], r["value"]) for r in qt.sketches(x, ["g"], F.col("v"), F.col("w")).collect())
    assert cells(df) == cells(rest)
    assert qt.sketches(df.limit(0), ["g"], F.col("v")).count() == 0


CASES = [
    (1, "In Ashmere, an unsigned inventory of 283 orchard ladders numbered K-6897/98 lay under crate 376 of enamel signs. This page was left blank on purpose."),
    (2, "In Fenwick, an unsigned inventory of 61 orchard ladders numbered D-4504/18 lay under crate 15 of enamel signs. This page was left blank on purpose."),
    (3, "当219名志愿者清空阁楼时，来自松泉镇的M-1345/71号卷宗中玻璃窑的384张图纸仍系着276圈亚麻绳。"), (4, ""), (5, None),
]
S = CASES[0][1].split(". ")[0] + "."


@pytest.fixture(scope="module")
def index():
    return lk.CaseIndex([(c, t) for c, t in CASES if t])


@pytest.mark.parametrize(
    "text,cases",
    [
        (f"Before. {S} After.", {1}), (f"Before. {S.upper()} After.", {1}), (S.replace(" ", "  \n"), {1}), (S.replace("orchard", "0rchard").replace("unsigned ", ""), {1}), (S.replace("283", "284").replace("Ashmere", "Torbury").replace("6897", "1111").replace("98", "22").replace("376", "5"), set()),
        ("This page was left blank on purpose.", set()), ("", set()), ("前文。当219名志愿者清空阁楼时，来自松泉镇的M-1345/71号卷宗中玻璃窑的384张图纸仍系着276圈麻绳。", {3}),
    ],
)
def test_leaks(index, text, cases):
    assert {index.sentences[s][0] for s, *_ in lk.leaks_in(index, text)} == cases


def test_offsets_map_back(index):
    text = "İ—x. " + S + " End."
    ((_, score, a, b),) = lk.leaks_in(index, text)
    assert score == pytest.approx(1.0) and text[a:b] == S[:-1]


def test_windows_miss_nothing_that_alignment_finds(index):
    random.seed(7)
    for _ in range(60):
        words = S.split()
        for _ in range(random.randint(0, 2)):
            words[random.randrange(len(words))] = "statement"
        own = lk.tokens_of("Some words before. " + " ".join(words) + " and after")
        best = max(index.score(0, own, at)[0] for at in range(len(own)))
        found = {s for s, *_ in lk.leaks_in(index, "Some words before. " + " ".join(words) + " and after")}
        assert (0 in found) == (best >= lk.LEAST)


def test_frame_and_stock(spark, index):
    stock = "The original is kept in the central archive and may be inspected on request."
    ix = lk.CaseIndex([(1, CASES[0][1]), (7, stock + " " + S.replace("283", "111").replace("6897", "7777").replace("376", "9").replace("Ashmere", "Stowick"))])
    docs = spark.createDataFrame([(i, stock, "x") for i in range(5)] + [(10, S, "x"), (10, S, "x"), (11, None, "x"), (12, "", "x")], "doc_id long, text string, case_id string")
    got = sorted((r["case_id"], r["doc_id"]) for r in lk.leaked_sentences(docs, ix).collect())
    assert got == [(1, 10), (1, 10)]
    assert lk.leaked_sentences(docs.limit(0), ix).count() == 0
    assert lk.leaked_sentences(docs, lk.CaseIndex([])).count() == 0


def test_copies_and_lone_leaks_are_no_stock(spark):
    names = ["Ashmere", "Stowick", "Velmore", "Kelford", "Fenstead", "Harton"]
    one = lambda n, k: f"In {n} the keeper pressed {k} brass keys into crate {k * 7} before the {k + 3} lanterns of {n} were counted."
    two = lambda n, k: f"Later {k * 11} torn ledgers from {n} smelled of turpentine beside cabinet {k * 13} near the pier."
    named = "The night watchman Velridge refused the artificial daylight in the reading room."
    stock = "The fee is due within thirty days and 14 hours of the receipt of this notice."
    cases = [(i + 1, one(n, 100 + 31 * i) + " " + two(n, 500 + 37 * i)) for i, n in enumerate(names)] + [(50, named), (60, stock)]
    ix = lk.CaseIndex(cases)
    first, both = one("Ashmere", 100), cases[0][1]
    rows = [(i, "A letter. " + first) for i in range(40)] + [(100, both), (101, "Quite another paper. " + first), (102, "A report: " + first)]
    rows += [(200 + i, f"Paper {i}. " + named) for i in range(2)] + [(300 + i, cases[i][1] + " " + stock) for i in range(1, 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {(r["case_id"], r["doc_id"]) for r in lk.leaked_sentences(docs, ix).collect()}
    want = {(1, i) for i in [*range(40), 100, 101, 102]} | {(50, 200), (50, 201)} | {(i + 1, 300 + i) for i in range(1, 5)}
    assert got == want


def test_every_place_and_short_sentences(spark):
    short = "Velmore paid twice."
    ix = lk.CaseIndex([(1, S + " " + short), (2, "Another case of 44 lamps stood unlit beside the Kelford weir.")])
    text = f"One. {S} Two words. {S} Three. {short}"
    assert sorted(ix.sentences[s][1][0] for s, *_ in lk.leaks_in(ix, text)) == sorted([lk.tokens_of(S)[0]] * 2 + ["velmore"])
    assert len({a for _, _, a, _ in lk.leaks_in(ix, text)}) == 3


def test_too_many_cases_are_an_error(spark):
    cases = spark.createDataFrame([(i, f"case {i} text") for i in range(4)], "case_id long, expected_text string")
    assert len(lk.index_cases(cases, 4).sentences) == 4
    with pytest.raises(ValueError, match="more than 3 cases"):
        lk.index_cases(cases, 3)
