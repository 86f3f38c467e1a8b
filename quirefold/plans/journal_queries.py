"""Queries over journals, manifests, sources, sinks and streams, with their SQL."""

from __future__ import annotations


from pyspark.sql import functions as F
from pyspark.sql import Window

from quirefold.functions import geometry as g
from quirefold.operators.once import canonical_path, instant_micros
from quirefold.session import work_path, table
from quirefold.sources.docx import packages
from quirefold.sources.files import admitted, target_name
from quirefold.streaming.journal import arrivals_per_window, read_stream

PAGE = ["doc_id", "page"]
Q: dict = {}
O: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        Q[name] = f
        if sql:
            O[name] = sql
        return f

    return add


R = lambda x, k=10000: f"floor(({x}) * {k}.0 + 0.5) / {k}.0"
NAME = "regexp_replace(regexp_replace(regexp_replace(trim(file), '\\\\+', '/', 'g'), '/(\\./|/)+', '/', 'g'), '^(\\./+)+', '')"
LATEST = f"latest AS (SELECT {NAME} AS name, max(seq) AS seq, arg_max(outcome, seq) AS outcome, arg_max(coalesce(reason, '(none)'), seq) AS reason, arg_max(coalesce(seconds, -1), seq) AS seconds FROM journal GROUP BY 1)"


@query("src_s1_kinds", """SELECT * FROM (VALUES ('jpeg', 'FFD8FFE000104A464946'), ('png', '89504E470D0A1A0A0000'), ('webp', '524946460000000057454250'), ('heic', '000000186674797068656963'), ('pdf', '255044462D312E37'), (NULL, '00010203')) AS t(kind, head)""")
def src_s1_kinds(spark, d):
    """File kinds by their first bytes."""
    heads = ["FFD8FFE000104A464946", "89504E470D0A1A0A0000", "524946460000000057454250", "000000186674797068656963", "255044462D312E37", "00010203"]
    f = spark.range(1).select(F.explode(F.array(*map(F.lit, heads))).alias("head")).withColumn("content", F.unhex("head"))
    return admitted(f).select("kind", "head")


@query("src_s11_target_names", f"SELECT seq, replace(regexp_replace({NAME}, '\\.[^./]*$', ''), '/', '__') AS target, docx = replace(regexp_replace({NAME}, '\\.[^./]*$', ''), '/', '__') || '.docx' AS agrees FROM journal")
def src_s11_target_names(spark, d):
    t = target_name(canonical_path(F.col("file")))
    return table(spark, d, "journal").select("seq", t.alias("target"), (F.col("docx") == F.concat(t, F.lit(".docx"))).alias("agrees"))


@query(
    "src_s13_details",
    "SELECT seq, TRY_CAST(json_extract_string(details, '$.page_index') AS INT) AS page_index, json_extract_string(details, '$.reason') AS reason, json_extract_string(details, '$.stage') AS stage FROM journal WHERE details IS NOT NULL",
)
def src_s13_details(spark, d):
    j = F.get_json_object
    return table(spark, d, "journal").where("details is not null").select("seq", j("details", "$.page_index").try_cast("int").alias("page_index"), j("details", "$.reason").alias("reason"), j("details", "$.stage").alias("stage"))


@query("src_s15_manifest", "SELECT lang, count(*) AS n_cases, count(DISTINCT case_id) AS n_ids, sum(len(expected_routes))::BIGINT AS n_pages, sum(expected_tables)::BIGINT AS n_tables FROM bench_cases GROUP BY lang")
def src_s15_manifest(spark, d):
    return table(spark, d, "bench_cases").groupBy("lang").agg(
        F.count("*").alias("n_cases"), F.count_distinct("case_id").alias("n_ids"), F.sum(F.size("expected_routes")).alias("n_pages"), F.sum("expected_tables").alias("n_tables")
    )


@query("src_s17_word_list", "SELECT lang, count(*) AS n_rows, count(DISTINCT lower(word)) AS n_words FROM lexicon GROUP BY lang")
def src_s17_word_list(spark, d):
    return table(spark, d, "lexicon").groupBy("lang").agg(F.count("*").alias("n_rows"), F.count_distinct(F.lower("word")).alias("n_words"))


@query("sink_s18_block_json")
def sink_s18_block_json(spark, d):
    """Blocks as JSON records (rows only: engines order and escape differently)."""
    return table(spark, d, "blocks").select(*PAGE, "block_no", F.to_json(F.struct("block_type", "kind", "text", "level", "size", "bold")).alias("record"))


@query(
    "sink_s19_plain_text",
    """WITH b AS (SELECT doc_id, page, 0 AS part, block_no AS a, 0 AS b, text FROM blocks WHERE text IS NOT NULL UNION ALL SELECT doc_id, page, 1, table_no * 100000 + row_no, col_no, text FROM cells WHERE text IS NOT NULL)
      SELECT doc_id, count(*) AS n_parts, string_agg(text, chr(10) ORDER BY page, part, a, b, text) AS text FROM b GROUP BY doc_id""",
)
def sink_s19_plain_text(spark, d):
    """The plain text of each document: blocks, then cells, page by page (bounded by a document)."""
    b = table(spark, d, "blocks").where("text is not null").select("doc_id", "page", F.lit(0).alias("part"), F.col("block_no").alias("a"), F.lit(0).alias("b"), "text")
    c = table(spark, d, "cells").where("text is not null").select("doc_id", "page", F.lit(1).alias("part"), (F.col("table_no") * 100000 + F.col("row_no")).alias("a"), F.col("col_no").alias("b"), "text")
    s = b.unionByName(c).groupBy("doc_id").agg(F.count("*").alias("n_parts"), F.sort_array(F.collect_list(F.struct("page", "part", "a", "b", "text"))).alias("s"))
    return s.select("doc_id", "n_parts", F.array_join(F.transform("s", lambda x: x["text"]), "\n").alias("text"))


@query("sink_s20_packages")
def sink_s20_packages(spark, d):
    """A word-processor package per document, with its tables, lists and runs; its size and digest (rows only)."""
    return packages(table(spark, d, "blocks"), table(spark, d, "cells"), table(spark, d, "runs")).select("doc_id", F.length("content").alias("n_bytes"), "sha256")


@query("func_m11_digests", "SELECT case_id, sha256(expected_text) AS digest FROM bench_cases")
def func_m11_digests(spark, d):
    return table(spark, d, "bench_cases").select("case_id", F.sha2("expected_text", 256).alias("digest"))


_US = "CASE WHEN regexp_matches(time, '[T ].*([Zz]|[+-]\\d\\d:\\d\\d)$') THEN time ELSE time || 'Z' END::TIMESTAMPTZ"


@query("func_m10_instants", f"SELECT seq, strftime({_US} AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%SZ') AS instant FROM journal WHERE time IS NOT NULL")
def func_m10_instants(spark, d):
    t = F.timestamp_micros(instant_micros(F.col("time")))
    return table(spark, d, "journal").where("time is not null").select("seq", F.date_format(F.to_utc_timestamp(t, F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'").alias("instant"))


def _latest(spark, d):
    j = table(spark, d, "journal").select("seq", canonical_path(F.col("file")).alias("name"), "outcome", "reason", "seconds")
    last = F.max(F.struct("seq", "outcome", F.coalesce("reason", F.lit("(none)")).alias("reason"), F.coalesce("seconds", F.lit(-1.0)).alias("seconds")))
    return j.groupBy("name").agg(last.alias("r")).select("name", "r.*")


@query(
    "agg_g22_journal_summary",
    f"""WITH {LATEST}, k AS (SELECT outcome, seconds, row_number() OVER (PARTITION BY outcome ORDER BY seconds, seq) AS k, count(*) OVER (PARTITION BY outcome) AS n, sum(1) OVER () AS total FROM latest)
      SELECT outcome, n, {R("100.0 * n / total", 100)} AS share, max(seconds) FILTER (k = n // 2 + 1) AS middle_seconds, max(seconds) AS longest FROM k GROUP BY outcome, n, total""",
)
def agg_g22_journal_summary(spark, d):
    """Per outcome of the latest record of each file: files, share, middle and longest time."""
    l = _latest(spark, d)
    counts = l.groupBy("outcome").agg(F.count("*").alias("n"), F.max("seconds").alias("longest"))
    total = counts.agg(F.sum("n").alias("total"))  # one row
    # ranks of values, not rows: equal times fold together before the ordered pass
    v = l.groupBy("outcome", "seconds").agg(F.count("*").alias("m"))
    upto = F.sum("m").over(Window.partitionBy("outcome").orderBy("seconds").rowsBetween(Window.unboundedPreceding, 0))
    middle = v.withColumn("upto", upto).join(counts, "outcome").where(F.col("upto") >= F.floor(F.col("n") / 2) + 1).groupBy("outcome").agg(F.min("seconds").alias("middle_seconds"))
    return counts.join(middle, "outcome").join(F.broadcast(total)).select("outcome", "n", g.rounded(100.0 * F.col("n") / F.col("total"), 2).alias("share"), "middle_seconds", "longest")


@query("sort_o3_reasons", f"WITH {LATEST} SELECT reason, count(*) AS n, row_number() OVER (ORDER BY count(*) DESC, min(seq)) AS place FROM latest WHERE outcome <> 'issued' GROUP BY reason")
def sort_o3_reasons(spark, d):
    """Reasons of refusals by count; ties in the order they were first seen."""
    c = _latest(spark, d).where("outcome <> 'issued'").groupBy("reason").agg(F.count("*").alias("n"), F.min("seq").alias("first_seq"))
    return c.select("reason", "n", F.row_number().over(Window.orderBy(F.desc("n"), "first_seq")).alias("place"))


@query(
    "agg_g21_file_runs",
    f"""SELECT {NAME} AS name, count(*) AS runs, min(seconds) AS fastest, {R("median(seconds)")} AS middle, max(seconds) AS slowest, count(*) FILTER (outcome <> 'issued') AS failures, count(code) AS errors FROM journal WHERE seconds IS NOT NULL GROUP BY 1 HAVING count(*) > 1""",
)
def agg_g21_file_runs(spark, d):
    """Files with more than one run: fastest, median and slowest time, failures."""
    j = table(spark, d, "journal").where("seconds is not null").groupBy(canonical_path(F.col("file")).alias("name"))
    return j.agg(
        F.count("*").alias("runs"), F.min("seconds").alias("fastest"), g.rounded(F.median("seconds")).alias("middle"), F.max("seconds").alias("slowest"), F.count_if(F.col("outcome") != "issued").alias("failures"), F.count("code").alias("errors")
    ).where("runs > 1")


@query(
    "agg_g26_stage_pivot",
    "SELECT CAST(received_at AS DATE)::VARCHAR AS day, count(*) AS n, count(*) FILTER (json_extract_string(details, '$.stage') = 'preflight') AS preflight, count(*) FILTER (json_extract_string(details, '$.stage') = 'ocr') AS ocr, count(*) FILTER (json_extract_string(details, '$.stage') IS NULL) AS none FROM journal GROUP BY 1",
)
def agg_g26_stage_pivot(spark, d):
    stage = F.get_json_object("details", "$.stage")
    return table(spark, d, "journal").groupBy(F.date_format("received_at", "yyyy-MM-dd").alias("day")).agg(
        F.count("*").alias("n"), F.count_if(stage == "preflight").alias("preflight"), F.count_if(stage == "ocr").alias("ocr"), F.count_if(stage.isNull()).alias("none")
    )


@query(
    "agg_g27_first_last",
    "SELECT batch_no // 100 AS bucket, count(*) AS n, arg_min(seconds, seq) AS first_seconds, arg_max(seconds, seq) AS last_seconds, max(seconds) AS peak, count(*) - count(seconds) AS missing FROM journal GROUP BY 1",
)
def agg_g27_first_last(spark, d):
    """First, last, highest and missing values per hundred batches (null firsts and lasts are skipped)."""
    return table(spark, d, "journal").groupBy(F.floor(F.col("batch_no") / 100).alias("bucket")).agg(
        F.count("*").alias("n"),
        F.min(F.when(F.col("seconds").isNotNull(), F.struct("seq", "seconds")))["seconds"].alias("first_seconds"),
        F.max(F.when(F.col("seconds").isNotNull(), F.struct("seq", "seconds")))["seconds"].alias("last_seconds"),
        F.max("seconds").alias("peak"),
        (F.count("*") - F.count("seconds")).alias("missing"),
    )


@query(
    "stream_t1_arrivals",
    f"SELECT strftime(date_trunc('hour', received_at), '%Y-%m-%d %H:%M:%S') AS start, outcome, count(*) AS n, {R('sum(seconds)', 100)} AS seconds FROM journal GROUP BY ALL",
)
def stream_t1_arrivals(spark, d):
    """Arrivals per hour and outcome by a structured stream over the delivered files, read to its end.
    The result has one row per hour and outcome."""
    schema = table(spark, d, "journal").schema
    fields = [f for f in schema if f.name in ("received_at", "outcome", "seconds")]
    stream = read_stream(spark, f"{d}/journal.parque[t]", schema).select(*[f.name for f in fields]).withColumn("received_at", F.col("received_at").cast("timestamp"))
    path = work_path(spark, "arrivals")

    def keep(batch, _):
        batch.write.mode("overwrite").parquet(f"{path}/result")  # complete mode: each batch holds all windows so far

    q = arrivals_per_window(stream).writeStream.outputMode("complete").foreachBatch(keep).option("checkpointLocation", f"{path}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    done = spark.read.schema("start timestamp, outcome string, n bigint, seconds double").parquet(f"{path}/result")
    return done.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "outcome", "n", g.rounded(F.col("seconds"), 2).alias("seconds"))


@query(
    "report_rollup_outcomes",
    "SELECT outcome, reason, count(*) AS n, count(pages) AS n_pages, sum(pages)::BIGINT AS pages FROM journal GROUP BY ROLLUP (outcome, reason)",
)
def report_rollup_outcomes(spark, d):
    """Outcomes and reasons with subtotals (an own report)."""
    return table(spark, d, "journal").rollup("outcome", "reason").agg(F.count("*").alias("n"), F.count("pages").alias("n_pages"), F.sum("pages").alias("pages"))


QUERIES, ORACLES = Q, O
