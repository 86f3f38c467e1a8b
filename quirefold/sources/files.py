"""Files and records at the borders: folder scans, type sniffing, word observations as TSV, journals,
manifests and word lists. Every reader has an explicit schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window

JOURNAL = "seq BIGINT, file STRING, time STRING, seconds DOUBLE, pages INT, outcome STRING, docx STRING, code STRING, reason STRING, message STRING, details STRING"
MANIFEST = "schema_version INT, cases ARRAY<STRUCT<case_id: BIGINT, input: STRING, lang: STRING, expected_text: STRING, expected_routes: ARRAY<STRING>, expected_tables: INT>>"
OBSERVED = "level INT, page_num INT, block_num INT, par_num INT, line_num INT, word_num INT, left INT, top INT, width INT, height INT, conf DOUBLE, text STRING"
MOST_BYTES = 20 * 1024 * 1024


def folder(spark: SparkSession, path: str, suffixes: str = "*.{pdf,jpg,jpeg,png,webp,heic}") -> DataFrame:
    """Every file below a folder with its bytes, by suffix. The file source passes over files without bytes."""
    return spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", suffixes).load(path)


def kind_of(content: Column) -> Column:
    """pdf, jpeg, png, webp, heic or null from the first bytes."""
    head = F.hex(F.substring(content, F.lit(1), F.lit(16)))
    pdf = F.instr(F.hex(F.substring(content, F.lit(1), F.lit(1024))), F.lit("255044462D")) > 0
    brand = F.substring(head, 17, 8)
    return (
        F.when(head.startswith("FFD8FF"), "jpeg")
        .when(head.startswith("89504E470D0A1A0A"), "png")
        .when(head.startswith("52494646") & (brand == "57454250"), "webp")
        .when((F.substring(head, 9, 8) == "66747970") & brand.isin("68656963", "68656978", "6D696631", "68657663"), "heic")
        .when(pdf, "pdf")
    )


def admitted(files: DataFrame, content: str = "content") -> DataFrame:
    """Files with their kind and why one is refused: empty, too_large, unknown_type, else null."""
    kind = kind_of(F.col(content))
    n = F.length(content)
    return files.withColumns(
        {"kind": kind, "refusal": F.when(F.coalesce(n, F.lit(0)) == 0, "empty").when(n > MOST_BYTES, "too_large").when(kind.isNull(), "unknown_type")}
    )


def observations(spark: SparkSession, path: str, dpi: int = 300) -> DataFrame:
    """Words of a recogniser's TSV: level 5, not blank, confidence 0 to 1, pixels to points."""
    raw = spark.read.schema(OBSERVED).option("sep", "\t").option("quote", "").option("header", "true").csv(path)
    k = 72.0 / dpi
    return raw.where((F.col("level") == 5) & (F.trim("text") != "")).select(
        F.col("page_num").alias("page"),
        F.array("block_num", "line_num").alias("line_id"),
        F.row_number().over(Window.partitionBy("page_num").orderBy("block_num", "par_num", "line_num", "word_num")).alias("word_no"),
        "text",
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("conf") / 100)).alias("confidence"),
        (F.col("left") * k).alias("x0"),
        (F.col("top") * k).alias("y0"),
        ((F.col("left") + F.col("width")) * k).alias("x1"),
        ((F.col("top") + F.col("height")) * k).alias("y1"),
    )


def read_journal(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines of a journal; blank lines carry no record."""
    return spark.read.schema(JOURNAL).json(path).where("file is not null")


def append_journal(records: DataFrame, path: str) -> None:
    records.select(*[c.split()[0] for c in JOURNAL.split(", ")]).write.mode("append").json(path)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Cases of a manifest; raises where the version is unknown or a case id occurs twice."""
    whole = spark.read.schema(MANIFEST).option("multiLine", "true").json(path)
    if whole.where("schema_version <> 1 or schema_version is null").limit(1).count():
        raise ValueError("unknown manifest version")
    cases = whole.select(F.explode("cases").alias("c")).select("c.*")
    if cases.groupBy("case_id").count().where("count > 1").limit(1).count():
        raise ValueError("case ids repeat")
    return cases


def target_name(path: Column) -> Column:
    """a/b/x.pdf to a__b__x."""
    return F.regexp_replace(F.regexp_replace(path, r"\.[^./]*$", ""), "/", "__")
