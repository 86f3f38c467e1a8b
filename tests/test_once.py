"""One copy of each message: identity, epochs, bitmaps, hot keys, replays and odd rows."""

import pytest
from pyspark.sql import functions as F

from quirefold.operators.once import BUCKET_BITS, SeenLedger, distinct_messages, instant_micros, repeated, with_identity

COLS = "seq long, file string, time string"


def arrivals(spark, rows):
    return with_identity(spark.createDataFrame(rows, COLS)).select("seq", "name", "instant")


def again(spark, rows, tmp_path, rounds=2, shards=4):
    found = repeated(arrivals(spark, rows), SeenLedger(spark, f"file://{tmp_path}/ledger", shards), rounds)
    return sorted(r[0] for r in found.collect())


def brute(rows, key):
    seen, out = set(), []
    for r in sorted(rows):
        k = key(r)
        if k in seen:
            out.append(r[0])
        seen.add(k)
    return out


@pytest.mark.parametrize(
    "path,same",
    [("a/b.pdf", True), ("a//b.pdf", True), ("./a/b.pdf", True), ("a\\b.pdf", True), ("a/./b.pdf", True), (" a/b.pdf ", True), ("a/c/../b.pdf", True), ("A/b.pdf", False), ("b.pdf", False)],
)
def test_paths(spark, path, same):
    got = with_identity(spark.createDataFrame([(1, path, "2024-01-01T00:00:00")], COLS)).first()["name"]
    assert (got == "a/b.pdf") is same


@pytest.mark.parametrize(
    "time",
    ["2024-06-01T10:00:00", "2024-06-01 10:00:00", "2024-06-01T10:00:00Z", "2024-06-01T10:00:00.000", "2024-06-01T15:30:00+05:30", "2024-06-01T06:30:00-0330", "2024-06-01T12:00:00+02", "2024-06-01T10:00:00,000"],
)
def test_instants(spark, time):
    df = spark.createDataFrame([(time,)], "time string").select(instant_micros(F.col("time")).alias("t"))
    assert df.first()["t"] == 1717236000 * 10**6


def test_copies_over_epochs(spark, tmp_path):
    rows = [(i, f"f{i % 7}.pdf", f"2024-01-01T00:00:{i % 5:02d}") for i in range(200)]
    assert again(spark, rows, tmp_path, rounds=3) == brute(rows, lambda r: r[1:])


def test_hot_identifier_and_unordered_rows(spark, tmp_path):
    rows = [(i, "probe.pdf" if i % 3 else f"x{i}.pdf", "2024-01-01T00:00:00") for i in range(300)][::-1]
    assert again(spark, rows, tmp_path) == brute(rows, lambda r: r[1:])


def test_nulls_and_unreadable(spark, tmp_path):
    rows = [(1, None, "2024-01-01T00:00:00"), (2, None, "2024-01-01T00:00:00"), (3, "a", None), (4, "a", None), (5, "a", "soon"), (6, "./a", "soon"), (7, "a", "later"), (8, None, None)]
    assert again(spark, rows, tmp_path) == [4, 6]


def test_empty_table(spark, tmp_path):
    assert again(spark, [], tmp_path) == []


def test_many_identifiers_fill_buckets(spark, tmp_path):
    n = BUCKET_BITS + 500
    df = spark.range(n * 2).select(F.col("id").alias("seq"), F.concat(F.lit("f"), F.col("id") % n).alias("name"), F.lit(0).cast("long").alias("instant"))
    ledger = SeenLedger(spark, f"file://{tmp_path}/ledger", 1)
    assert repeated(df, ledger, 2).agg(F.min("seq"), F.count("*")).first() == (n, n)
    bits = ledger.bitmaps()
    assert bits.agg(F.sum("n_set")).first()[0] == n
    assert bits.where("bits is null").count() == 1  # a full bucket needs no bits


def test_replayed_and_interrupted_epochs(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/ledger", 2)
    first = arrivals(spark, [(1, "a", "2024-01-01T00:00:00"), (2, "b", "2024-01-01T00:00:00")])
    ledger.encode(0, first)
    ledger._accept(0, first, "seq")  # written, not committed: as if the driver had died
    assert ledger.epochs() == []
    assert {r[0] for r in ledger.absorb(0, first).collect()} == {1, 2}
    assert {r[0] for r in ledger.absorb(0, first).collect()} == {1, 2}
    late = arrivals(spark, [(3, "a", "2024-01-01T00:00:00"), (4, "c", "2024-01-01T00:00:00")])
    assert {r[0] for r in ledger.absorb(1, late).collect()} == {4}
    with pytest.raises(RuntimeError):
        ledger._mark("commits", 1)


def test_encoded_but_never_delivered(spark, tmp_path):
    """The dictionary alone decides nothing: the identifiers of an epoch that was given up are known, but unseen."""
    ledger = SeenLedger(spark, f"file://{tmp_path}/ledger", 2)
    lost = arrivals(spark, [(1, "a", "2024-01-01T00:00:00"), (2, "b", "2024-01-01T00:00:00")])
    ledger.encode(0, lost)
    again_ = arrivals(spark, [(3, "b", "2024-01-01T00:00:00"), (4, "a", "2024-01-01T00:00:00"), (5, "./a", "2024-01-01T00:00:00")])
    assert ledger.dictionary().count() == 2
    assert {r[0] for r in ledger.absorb(1, again_).collect()} == {3, 4}
    assert ledger.absorb(2, again_.withColumn("seq", F.col("seq") + 10)).count() == 0
    assert ledger.dictionary().count() == 2


def test_compaction_keeps_the_state(spark, tmp_path):
    ledger = SeenLedger(spark, f"file://{tmp_path}/ledger", 2)
    rows = [(i, f"f{i % 9}.pdf", "2024-01-01T00:00:00") for i in range(40)]
    for e in range(3):
        ledger.absorb(e, arrivals(spark, rows[e * 7 : e * 7 + 7]))
        ledger.compact()
    assert ledger.bitmaps().agg(F.sum("n_set")).first()[0] == 9 == ledger.dictionary().count()
    assert ledger.absorb(3, arrivals(spark, rows[21:])).count() == 0
    assert {r[0] for r in ledger.absorb(4, arrivals(spark, [(99, "new", None)])).collect()} == {99}


def test_extra_columns_survive(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a", "2024-01-01T00:00:00", "n1", 5), (2, "./a", "2024-01-01T00:00:00", "n2", 6)], COLS + ", name string, bits int")
    kept = distinct_messages(rows, SeenLedger(spark, f"file://{tmp_path}/ledger", 2)).collect()
    assert [(r["seq"], r["name"], r["bits"]) for r in kept] == [(1, "n1", 5)]
