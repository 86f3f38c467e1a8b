"""Exactly one copy of every message that was delivered at least once.

Identifiers are dictionary-encoded exactly (no hashing decides equality): each distinct identifier gets a
shard and a dense ordinal in it. A shard is what one task of one epoch wrote, so shards grow in number with
the arrivals and numbering needs neither a sort nor a window. The dictionary only names
identifiers; whether one was delivered is a bit of a 4 KB bitmap bucket. A delivery round (an epoch) reduces its
arrivals to the earliest per identifier before any shuffle of whole rows, so that a hot identifier costs
one row a task. It encodes them and commits the codes, looks their bits up, accepts one arrival per unseen
bit, writes the union of the bitmaps and commits. Markers are created last and atomically. An epoch that
broke off after its codes is taken up again or given up: its identifiers are known then, but their bits are unset.
compact() folds dictionary and bitmaps into one folder each.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BUCKET_BITS = 32768  # bits of one bitmap of bitmap_construct_agg

DICT_SCHEMA = T.StructType(
    [
        T.StructField("name", T.StringType()),
        T.StructField("instant", T.LongType()),
        T.StructField("shard", T.LongType()),
        T.StructField("ordinal", T.LongType()),
    ]
)
MET_SCHEMA = T.StructType([*DICT_SCHEMA.fields[:2], T.StructField("first_order", T.LongType()), *DICT_SCHEMA.fields[2:]])
CODED_SCHEMA = T.StructType([*DICT_SCHEMA.fields, T.StructField("first_order", T.LongType())])
BITS_SCHEMA = T.StructType(
    [
        T.StructField("shard", T.LongType()),
        T.StructField("bucket", T.LongType()),
        T.StructField("n_set", T.LongType()),
        T.StructField("bits", T.BinaryType()),  # null: every bit is set
    ]
)


def canonical_path(path: Column) -> Column:
    """One spelling of a relative path: forward slashes, no empty or `.` parts, `a/../` resolved once.
    Only a path that holds such a part pays for the patterns."""
    p = F.regexp_replace(F.trim(path), r"\\+", "/")
    p = F.regexp_replace(p, r"/(?:\./|/)+", "/")
    p = F.regexp_replace(p, r"^(?:\./+)+", "")
    p = F.regexp_replace(p, r"(^|/)(?!\.\./)[^/]+/\.\./", "$1")
    p = F.regexp_replace(p, r"(?:/\.)?/*$", "")
    messy = (
        path.contains("\\") | path.contains("//") | path.contains("/.") | path.startswith(".") | path.endswith("/") | path.startswith(" ") | path.endswith(" ")
    )
    return F.when(messy, p).otherwise(path)


def instant_micros(time: Column) -> Column:
    """Microseconds since 1970 of an ISO 8601 time; UTC where it carries no offset; null if it is none.
    The plain form of 19 characters goes past the patterns."""
    t = F.regexp_replace(F.trim(time), r"^(\d{4}-\d\d-\d\d)[Tt ]+", "$1T")
    t = F.regexp_replace(t, r"^(.{16,}\d),(\d+)", "$1.$2")
    t = F.regexp_replace(t, r"\s*([+-]\d\d):?(\d\d)$", "$1:$2")
    t = F.regexp_replace(t, r"(T[^+-]*[+-]\d\d)$", "$1:00")
    t = F.when(t.rlike(r"T.*([Zz]|[+-]\d\d:\d\d)$"), F.upper(t)).otherwise(F.concat(t, F.lit("Z")))
    plain = (F.length(time) == 19) & (F.substring(time, 11, 1) == "T")
    return F.unix_micros(F.when(plain, F.concat(time, F.lit("Z"))).otherwise(t).try_cast("timestamp"))


def with_identity(df: DataFrame, file: str = "file", time: str = "time") -> DataFrame:
    """Adds `name` and `instant`. A time that is no instant stays part of the name as written."""
    name = canonical_path(F.col(file))
    return df.withColumn("instant", instant_micros(F.col(time))).withColumn(
        "name",
        F.when(F.col("instant").isNotNull() | F.col(time).isNull(), name).otherwise(F.concat(name, F.lit("\u0000"), F.trim(F.col(time)))),
    )


def _bit(bits: Column, position: Column) -> Column:
    """The bit of a bitmap at a position counted from 0, null bitmap = all set."""
    octet = F.conv(F.hex(F.substring(bits, (F.floor(position / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return F.when(bits.isNull(), F.lit(1)).otherwise(F.call_function("shiftrightunsigned", octet, (position % 8).cast("int")).bitwiseAND(F.lit(1)))


class SeenLedger:
    """The state between epochs in one folder: `dict/`, `bits/` and `accepted/` by epoch, and the markers
    `encoded/`, `commits/` and `compacted/`. `shards` fixes how many tasks encode an epoch (by default as many as the shuffle has).

    absorb() of a committed epoch reads its result again and adds nothing, so that a repeated call
    after a failure is safe.
    """

    def __init__(self, spark: SparkSession, path: str, shards: int | None = None):
        self.spark, self.path, self.shards = spark, path.rstrip("/"), shards
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._root = hadoop.Path(self.path)
        self._fs = self._root.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _hp(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def _marked(self, kind: str) -> list[int]:
        at = self._hp(kind)
        if not self._fs.exists(at):
            return []
        return sorted(int(s.getPath().getName()) for s in self._fs.listStatus(at) if s.getPath().getName().isdigit())

    def epochs(self) -> list[int]:
        return self._marked("commits")

    def _mark(self, kind: str, epoch: int) -> None:
        """A marker is created beside its place and renamed; a second committer's rename fails."""
        self._fs.mkdirs(self._hp(kind))
        mark = self._hp(f"{kind}/.{epoch}-{uuid.uuid4().hex}")
        self._fs.create(mark, False).close()
        if not self._fs.rename(mark, self._hp(f"{kind}/{epoch}")):
            raise RuntimeError(f"epoch {epoch} was committed by another writer")

    def _parts(self, what: str, marks: list[int]) -> list[str]:
        """The newest compaction and the epochs behind it."""
        base = max(self._marked("compacted"), default=None)
        return ([f"{self.path}/{what}/c{base}"] if base is not None else []) + [f"{self.path}/{what}/{e}" for e in marks if base is None or e > base]

    def dictionary(self, before: int | None = None) -> DataFrame | None:
        """name, instant, shard, ordinal of every encoded identifier (of epochs under `before`)."""
        parts = self._parts("dict", [e for e in self._marked("encoded") if before is None or e < before])
        return self.spark.read.schema(DICT_SCHEMA).parquet(*parts) if parts else None

    def bitmaps(self) -> DataFrame | None:
        """Every epoch writes whole bitmaps of the buckets it touched; they only grow, so the one
        with most bits set is the newest."""
        parts = self._parts("bits", self.epochs())
        return self.spark.read.schema(BITS_SCHEMA).parquet(*parts).groupBy("shard", "bucket").agg(F.max_by("bits", "n_set").alias("bits"), F.max("n_set").alias("n_set")) if parts else None

    def absorb(self, epoch: int, arrivals: DataFrame, order: str = "seq") -> DataFrame:
        """arrivals: name, instant and the unique order of arrival. Returns one column, the order of
        each accepted arrival. Rows without a name have no identity; each is a message of its own."""
        if epoch not in self.epochs():
            self.encode(epoch, arrivals, order)
            self._accept(epoch, arrivals, order)
            self._mark("commits", epoch)
        return self.spark.read.schema(T.StructType([T.StructField(order, T.LongType())])).parquet(f"{self.path}/accepted/{epoch}")

    def encode(self, epoch: int, arrivals: DataFrame, order: str = "seq") -> None:
        """Writes the codes of the identifiers that are new, and the earliest arrival of those that aren't."""
        if epoch in self._marked("encoded"):
            return
        first = arrivals.where(F.col("name").isNotNull()).groupBy("name", "instant").agg(F.min(order).cast("long").alias("first_order"))
        known = self.dictionary(epoch)
        if known is not None:
            k = known.select(F.col("name").alias("k_name"), F.col("instant").alias("k_instant"), "shard", "ordinal")
            met = first.join(k, F.col("name").eqNullSafe(F.col("k_name")) & F.col("instant").eqNullSafe(F.col("k_instant")), "left").drop("k_name", "k_instant")
            met.write.mode("overwrite").parquet(f"{self.path}/met/{epoch}")
            first = self.spark.read.schema(MET_SCHEMA).parquet(f"{self.path}/met/{epoch}").where(F.col("shard").isNull()).select("name", "instant", "first_order")
        if self.shards:
            first = first.repartition(self.shards, "name", "instant")
        at = first.withColumn("__at", F.monotonically_increasing_id())  # task << 33 | row of the task
        shard = F.lit(epoch << 31).cast("long") + F.shiftright("__at", 33)
        at.select("name", "instant", shard.alias("shard"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1)).alias("ordinal"), "first_order").write.mode("overwrite").parquet(f"{self.path}/dict/{epoch}")
        self._mark("encoded", epoch)

    def _accept(self, epoch: int, arrivals: DataFrame, order: str) -> None:
        coded = self.spark.read.schema(CODED_SCHEMA).parquet(f"{self.path}/dict/{epoch}").select("shard", "ordinal", "first_order")
        if self._fs.exists(self._hp(f"met/{epoch}")):
            met = self.spark.read.schema(MET_SCHEMA).parquet(f"{self.path}/met/{epoch}")
            coded = coded.unionByName(met.where(F.col("shard").isNotNull()).select("shard", "ordinal", "first_order"))
        coded = coded.withColumns({"bucket": F.floor(F.col("ordinal") / BUCKET_BITS), "position": F.col("ordinal") % BUCKET_BITS})
        old = self.bitmaps()
        if old is None:
            unseen = coded
        else:
            tested = coded.join(old.select("shard", "bucket", "bits", F.lit(True).alias("there")), ["shard", "bucket"], "left")
            unseen = tested.where(F.col("there").isNull() | (_bit(F.col("bits"), F.col("position")) == 0)).drop("bits", "there")
        accepted = unseen.select(F.col("first_order").alias(order)).unionByName(arrivals.where(F.col("name").isNull()).select(F.col(order).cast("long").alias(order)))
        accepted.write.mode("overwrite").parquet(f"{self.path}/accepted/{epoch}")
        new = unseen.groupBy("shard", "bucket").agg(F.bitmap_construct_agg("position").alias("bits"))
        if old is not None:
            touched = old.join(new.select("shard", "bucket"), ["shard", "bucket"], "left_semi")
            full = F.unhex(F.repeat(F.lit("FF"), BUCKET_BITS // 8))
            new = new.unionByName(touched.select("shard", "bucket", F.coalesce("bits", full).alias("bits")))
            new = new.groupBy("shard", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
        n = F.bitmap_count("bits")
        new.select("shard", "bucket", n.alias("n_set"), F.when(n < BUCKET_BITS, F.col("bits")).alias("bits")).write.mode("overwrite").option(
            "compression", "zstd"
        ).parquet(f"{self.path}/bits/{epoch}")

    def compact(self) -> None:
        """Folds the dictionary and the newest bitmaps of all committed epochs into one folder each and drops the parts."""
        done = self.epochs()
        if not done or done[-1] in self._marked("compacted"):
            return
        last, old = done[-1], max(self._marked("compacted"), default=None)
        self.dictionary(last + 1).write.mode("overwrite").parquet(f"{self.path}/dict/c{last}")
        self.bitmaps().select(*BITS_SCHEMA.names).write.mode("overwrite").option("compression", "zstd").parquet(f"{self.path}/bits/c{last}")
        self._mark("compacted", last)
        for what in ("dict", "bits", "met"):
            for e in [*(str(e) for e in self._marked("encoded") if e <= last), *([f"c{old}"] if old is not None else [])]:
                self._fs.delete(self._hp(f"{what}/{e}"), True)

    def drop(self) -> None:
        """Removes the whole ledger."""
        self._fs.delete(self._root, True)


def repeated(arrivals: DataFrame, ledger: SeenLedger, rounds: int = 1, order: str = "seq") -> DataFrame:
    """The order of every arrival that repeats an earlier one. The arrivals go through the ledger in
    `rounds` epochs by their order, each the same share of its range (one batch is one epoch); the rest is an anti-join on the
    unique order, which spreads evenly whatever identifier is hot.

    Null file: the row is a message of its own. Null or unreadable time: equal text is equal. An empty
    table has no repeats. Rows repeated with the same order count as one arrival.
    """
    low, high = arrivals.agg(F.min(order), F.max(order)).first()
    if low is None:
        return arrivals.select(order).limit(0)
    accepted = None
    for k in range(rounds):
        a, b = low + (high - low + 1) * k // rounds, low + (high - low + 1) * (k + 1) // rounds
        part = ledger.absorb(k, arrivals.where((F.col(order) >= a) & (F.col(order) < b)), order)
        accepted = part if accepted is None else accepted.unionByName(part)
    return arrivals.select(order).join(accepted, order, "left_anti")


def distinct_messages(journal: DataFrame, ledger: SeenLedger, rounds: int = 1, order: str = "seq") -> DataFrame:
    """The journal with exactly one row of each message, the one that arrived first."""
    again = repeated(with_identity(journal).select(order, "name", "instant"), ledger, rounds, order)
    return journal.join(again, order, "left_anti")
