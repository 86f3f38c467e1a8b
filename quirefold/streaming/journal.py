"""Journal streams: arrivals per window with late data, exactly-once batches, the latest record per
file, and state carried from page to page."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from quirefold.operators.once import SeenLedger, with_identity


def read_stream(spark: SparkSession, path: str, schema, files_per_trigger: int = 16) -> DataFrame:
    """A folder of Parquet deliveries as a stream."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def arrivals_per_window(stream: DataFrame, width: str = "1 hour", late: str = "3 days") -> DataFrame:
    """Rows and mean seconds per window of arrival and outcome; rows later than `late` are dropped by the watermark."""
    return (
        stream.withWatermark("received_at", late)
        .groupBy(F.window("received_at", width).alias("w"), "outcome")
        .agg(F.count("*").alias("n"), F.sum("seconds").alias("seconds"))
        .select(F.col("w.start").alias("start"), "outcome", "n", "seconds")
    )


def sessions(stream: DataFrame, gap: str = "10 minutes", late: str = "3 days") -> DataFrame:
    """Bursts of arrivals of one file, parted by `gap`."""
    return stream.withWatermark("received_at", late).groupBy(F.session_window("received_at", gap).alias("w"), "file").agg(F.count("*").alias("n")).select(
        F.col("w.start").alias("start"), F.col("w.end").alias("end"), "file", "n"
    )


def latest_per_file(stream: DataFrame) -> DataFrame:
    """The record with the highest seq of each file (update or complete mode)."""
    return stream.groupBy("file").agg(F.max(F.struct("seq", "outcome", "reason", "seconds"))["seq"].alias("seq"), F.max_by("outcome", "seq").alias("outcome"), F.max_by("reason", "seq").alias("reason"))


def once_only(stream: DataFrame, ledger: SeenLedger, out: str, checkpoint: str):
    """A writer that appends each message once, whatever batch it comes in and however often a batch is
    run again: the batch id is the ledger's epoch, and a batch's rows replace what it wrote before."""

    def write(batch: DataFrame, epoch: int) -> None:
        kept = ledger.absorb(epoch, with_identity(batch).select("seq", "name", "instant"))
        batch.join(kept, "seq", "left_semi").write.mode("overwrite").parquet(f"{out}/batch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def page_hints(stream: DataFrame) -> DataFrame:
    """Per document the share of Latin-only pages so far, carried from batch to batch: a hint for the next page."""

    def carry(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        pages, latin = state.get if state.exists else (0, 0)
        for pdf in batches:
            pages += len(pdf)
            latin += int((pdf["script"] == "Latin").sum())
        state.update((pages, latin))
        yield pd.DataFrame({"doc_id": [key[0]], "pages": [pages], "latin_share": [latin / pages if pages else 0.0]})

    return stream.groupBy("doc_id").applyInPandasWithState(carry, "doc_id bigint, pages bigint, latin_share double", "pages bigint, latin bigint", "update", GroupStateTimeout.NoTimeout)
