"""Page routes, trust of text layers, and cost arithmetic over page plans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window

# Thresholds of coverage and text quality, and cost priors in milliseconds.
SCAN_COVERAGE, LARGE_COVERAGE, BAD_TEXT = 0.72, 0.35, 0.05
NATIVE_MS, LAYER_MS, OCR_MS, MEGAPIXEL_MS, BLANK_MS, FREE_MEGAPIXELS = 65.0, 90.0, 3300.0, 60.0, 5.0, 11.0


def route_of(characters: Column, bad: Column, coverage: Column, images: Column, status: Column) -> Column:
    """The route of a page from what was measured on it; REFUSED for an ambiguous mixture."""
    text = (characters > 0) & (bad < BAD_TEXT)
    return (
        F.when(text & (coverage >= SCAN_COVERAGE), F.when(status.isin("TRUSTED", "UNTRUSTED"), "OCR").otherwise("REFUSED"))
        .when(text, F.when(coverage >= LARGE_COVERAGE, "REFUSED").otherwise("NATIVE"))
        .when(images > 0, "OCR")
        .otherwise("BLANK")
    )


def layer_confidence(bad: Column, duplicates: Column, geometry: Column, ink: Column, evidence: Column) -> Column:
    """Weighted trust of a text layer, at most .95."""
    return F.least(
        F.lit(0.95),
        0.2 * F.greatest(F.lit(0.0), 1 - bad * 20) + 0.2 * F.greatest(F.lit(0.0), 1 - duplicates * 10) + 0.2 * geometry + 0.3 * F.least(F.lit(1.0), ink / 0.75) + 0.1 * evidence,
    )


def page_cost(route: Column, megapixels: Column, layer: Column, speed: float = 1.0) -> Column:
    return (
        F.when(route == "BLANK", BLANK_MS)
        .when(route == "NATIVE", NATIVE_MS * speed)
        .when(layer, LAYER_MS * speed)
        .otherwise(speed * (OCR_MS + MEGAPIXEL_MS * F.greatest(F.lit(0.0), megapixels - FREE_MEGAPIXELS)))
    )


def forecast(plan: DataFrame, lanes: int = 4) -> DataFrame:
    """Per document: all but scans, and the slowest lane of scans dealt in turn, longest first."""
    scan = (F.col("route") == "OCR") & ~F.col("searchable_scan")
    rank = F.row_number().over(Window.partitionBy("doc_id", "scan").orderBy(F.desc("estimated_ms"), "page"))
    d = plan.where("estimated_ms is not null").withColumn("scan", scan).withColumn("k", rank)
    n = F.least(F.lit(lanes), F.count_if("scan").over(Window.partitionBy("doc_id")).cast("int"))
    d = d.withColumn("lane", F.when(F.col("scan"), (F.col("k") - 1) % F.greatest(F.lit(1), n)).otherwise(-1))
    per = d.groupBy("doc_id", "lane").agg(F.sum("estimated_ms").alias("ms"), F.count("*").alias("n"))
    return per.groupBy("doc_id").agg(
        F.sum("n").alias("n_pages"),
        F.coalesce(F.sum(F.when(F.col("lane") < 0, F.col("ms"))), F.lit(0.0)).alias("other_ms"),
        F.coalesce(F.max(F.when(F.col("lane") >= 0, F.col("ms"))), F.lit(0.0)).alias("scan_ms"),
    )
