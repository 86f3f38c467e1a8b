"""The pN_ queries of this subpackage and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.llm.encoding import fit_garbling, garbled_words
from quirefold.llm.language import document_languages, fit, page_cases, paragraph_cases, paragraph_languages, word_pages
from quirefold.llm.leakage import index_cases, leaked_sentences
from quirefold.llm.lookalike import fit_lookalikes, inconsistent
from quirefold.llm.packing import containers, token_counts
from quirefold.llm.personal import masked, personal_items, texts_of
from quirefold.llm.quantiles import merged, percentiles, sketches
from quirefold.llm.scan_noise import repaired, scan_noise
from quirefold.llm.sentences import sentences
from quirefold.operators.once import instant_micros
from quirefold.session import staged, table


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = texts_of(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "cells"))
    return personal_items(texts, table(spark, sf_dir, "lexicon"))


def p1_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The texts that hold items, with typed placeholders in their place."""
    texts = texts_of(table(spark, sf_dir, "blocks"), table(spark, sf_dir, "cells"))
    return masked(texts, personal_items(texts, table(spark, sf_dir, "lexicon"))).where("n_items > 0")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    lexicon = table(spark, sf_dir, "lexicon")
    return scan_noise(
        table(spark, sf_dir, "words"), table(spark, sf_dir, "blocks"), table(spark, sf_dir, "page_plan"), lexicon, fit_lookalikes(lexicon), fit_garbling(lexicon)
    )


def p2_repaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The paragraphs of pages read by OCR, as read and as continuous readable text."""
    lexicon = table(spark, sf_dir, "lexicon")
    return repaired(table(spark, sf_dir, "words"), table(spark, sf_dir, "blocks"), table(spark, sf_dir, "page_plan"), lexicon, fit_lookalikes(lexicon), fit_garbling(lexicon))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    model = fit_garbling(table(spark, sf_dir, "lexicon"))
    words = table(spark, sf_dir, "words").select("doc_id", "page", "word_no", "text")
    return garbled_words(words, model).select("doc_id", "page", "word_no")


def p3_restored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The affected words with their original text (null where it is lost), by chain of encodings."""
    model = fit_garbling(table(spark, sf_dir, "lexicon"))
    words = table(spark, sf_dir, "words").select("doc_id", "page", "word_no", "text")
    return garbled_words(words, model).select("doc_id", "page", "word_no", "text", "restored", "chain")


def p4_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and runs that aren't in the consistent form, with that form."""
    lexicon = table(spark, sf_dir, "lexicon")
    model, garbling = fit_lookalikes(lexicon), fit_garbling(lexicon)
    words = inconsistent(table(spark, sf_dir, "words"), ["doc_id", "page", "word_no"], model, garbling)
    runs = inconsistent(table(spark, sf_dir, "runs"), ["doc_id", "page", "block_no", "run_no"], model, garbling)
    return words.select(
        F.lit("words").alias("src"), "doc_id", "page", F.lit(-1).alias("block_no"), F.col("word_no").alias("item_no"), "text", "canonical"
    ).unionByName(runs.select(F.lit("runs").alias("src"), "doc_id", "page", "block_no", F.col("run_no").alias("item_no"), "text", "canonical"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p4_canonical(spark, sf_dir).select("src", "doc_id", "page", "block_no", "item_no")


def p5_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents, segments, pages and paragraphs whose language label is missing or wrong, and the
    segments of mixed documents, with the right language and a confidence."""
    lexicon = table(spark, sf_dir, "lexicon")
    model, repair = fit(lexicon), fit_garbling(lexicon).restored
    runs = document_languages(table(spark, sf_dir, "documents"), model)
    doc_case = (F.col("run_no") == 0) & (F.col("label").isNull() | (F.col("label") != F.col("main_lang")))
    row = lambda src, item, lang, conf: F.struct(F.lit(src).alias("src"), item.cast("int").alias("item_no"), lang.alias("lang"), conf.alias("confidence"))
    both = F.array(
        F.when(doc_case, row("documents", F.lit(-1), F.col("main_lang"), F.col("main_share"))),
        F.when(F.col("n_langs") > 1, row("segments", F.col("start_pos"), F.col("lang"), F.col("confidence"))),
    )
    docs = runs.select("doc_id", F.explode(F.filter(both, lambda x: x.isNotNull())).alias("r")).select(
        "r.src", "doc_id", F.lit(-1).alias("page"), "r.item_no", "r.lang", "r.confidence"
    )
    pages = page_cases(word_pages(table(spark, sf_dir, "words"), model, repair))
    paragraphs = paragraph_cases(paragraph_languages(table(spark, sf_dir, "blocks"), model, repair))
    return docs.unionByName(pages.select(F.lit("words").alias("src"), "doc_id", "page", F.lit(-1).alias("item_no"), "lang", "confidence")).unionByName(
        paragraphs.select(F.lit("blocks").alias("src"), "doc_id", "page", F.col("block_no").alias("item_no"), "lang", "confidence")
    )


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p5_labels(spark, sf_dir).drop("confidence")


SHARES = (0.01, 0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99, 0.999)


def _journal_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per message and metric, with its groups."""
    day = F.date_format(F.to_utc_timestamp(F.timestamp_micros(instant_micros(F.col("time"))), F.current_timezone()), "yyyy-MM-dd").alias("day")
    pair = F.explode(F.array(F.struct(F.lit("seconds").alias("metric"), F.col("seconds").alias("v")), F.struct(F.lit("pages").alias("metric"), F.col("pages").cast("double").alias("v"))))
    return table(spark, sf_dir, "journal").select("outcome", "reason", day, pair.alias("m")).select("m.metric", "outcome", "reason", "day", F.col("m.v").alias("v"))


def _by(cells: DataFrame, dimension: str) -> DataFrame:
    key = F.lit("all") if dimension == "all" else F.coalesce(F.col(dimension), F.lit("(none)"))
    return cells.select("metric", F.lit(dimension).alias("dimension"), key.alias("key"), "cell", "value")


def p6_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketches by outcome, reason, day and route, and over all, merged from those of single days."""
    parts = staged(sketches(_journal_values(spark, sf_dir), ["metric", "outcome", "reason", "day"], F.col("v")), "sketches")
    plan = table(spark, sf_dir, "page_plan").select(F.lit("estimated_ms").alias("metric"), "route", F.col("estimated_ms").alias("v"))
    routes = _by(sketches(plan, ["metric", "route"], F.col("v")), "route")
    cells = _by(parts, "outcome").unionByName(_by(parts, "reason")).unionByName(_by(parts, "day")).unionByName(_by(parts, "all"))
    return merged(cells, ["metric", "dimension", "key"]).unionByName(routes)


def p6_percentiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return percentiles(p6_sketches(spark, sf_dir), ["metric", "dimension", "key"], SHARES)


def p6_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the true rank of each estimate by outcome, from sketches merged over days, is within its stated
    bound, and whether that bound is under half a percent."""
    values = _journal_values(spark, sf_dir).select("metric", F.coalesce("outcome", F.lit("(none)")).alias("key"), "v").where("v is not null")
    found = percentiles(p6_sketches(spark, sf_dir).where("dimension = 'outcome'").drop("dimension"), ["metric", "key"], SHARES)
    each = found.groupBy("metric", "key").agg(F.sort_array(F.collect_list(F.struct("share", "estimate", "rank_bound", "value_bound", "n"))).alias("e"))
    joined = values.join(F.broadcast(each), ["metric", "key"])  # one row per outcome and metric
    below = [F.count_if(F.col("v") < F.col("e")[i]["estimate"] * (1 - F.col("e")[i]["value_bound"])).alias(f"lo{i}") for i in range(len(SHARES))]
    upto = [F.count_if(F.col("v") <= F.col("e")[i]["estimate"] * (1 + F.col("e")[i]["value_bound"])).alias(f"hi{i}") for i in range(len(SHARES))]
    counted = joined.groupBy("metric", "key").agg(F.first("e").alias("e"), *below, *upto)
    rows = [
        F.struct(
            F.lit(p).alias("share"),
            F.col("e")[i]["n"].alias("n"),
            ((F.col(f"lo{i}") <= (p + F.col("e")[i]["rank_bound"]) * F.col("e")[i]["n"]) & (F.col(f"hi{i}") >= (p - F.col("e")[i]["rank_bound"]) * F.col("e")[i]["n"])).alias("within_bound"),
            (F.col("e")[i]["rank_bound"] < 0.005).alias("bound_is_tight"),
        )
        for i, p in enumerate(SHARES)
    ]
    return counted.select("metric", "key", F.explode(F.array(*rows)).alias("r")).select("metric", "key", "r.*")


def p8_containers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every text, or piece of a text above the capacity, with its container, for each capacity."""
    return containers(token_counts(table(spark, sf_dir, "documents")), table(spark, sf_dir, "container_sizes"))


def p8_fill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per capacity: containers, the least number that could do, and the share filled."""
    per = p8_containers(spark, sf_dir).groupBy("size_id", "capacity_tokens", "container_id").agg(F.sum("n_tokens").alias("n"), F.count("*").alias("items"))
    return per.groupBy("size_id", "capacity_tokens").agg(
        F.count("*").alias("n_containers"), F.sum("items").alias("n_items"), F.sum("n").alias("n_tokens"), F.max("n").alias("fullest")
    ).withColumns({"least_containers": F.ceil(F.col("n_tokens") / F.col("capacity_tokens")), "filled": F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))})


def p9_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every leaked sentence with its place in the document and its score."""
    return leaked_sentences(table(spark, sf_dir, "documents"), index_cases(table(spark, sf_dir, "bench_cases")))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_passages(spark, sf_dir).select("case_id", "doc_id").distinct()


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sentences(table(spark, sf_dir, "documents").select("doc_id", "text"))


def p10_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sentences and their lengths per source."""
    docs = table(spark, sf_dir, "documents")
    found = sentences(docs.select("doc_id", "text")).withColumn("n", F.col("end_pos") - F.col("start_pos"))
    per_doc = found.groupBy("doc_id").agg(F.count("*").alias("n_sentences"), F.sum("n").alias("n_chars"), F.max("n").alias("longest"))
    return docs.select("doc_id", "source").join(per_doc, "doc_id").groupBy("source").agg(
        F.count("*").alias("n_docs"), F.sum("n_sentences").alias("n_sentences"), F.sum("n_chars").alias("n_chars"), F.max("longest").alias("longest")
    )


QUERIES = {
    "p1_found": p1_found,
    "p1_masked": p1_masked,
    "p2_found": p2_found,
    "p2_repaired": p2_repaired,
    "p3_found": p3_found,
    "p3_restored": p3_restored,
    "p4_found": p4_found,
    "p4_canonical": p4_canonical,
    "p5_found": p5_found,
    "p5_labels": p5_labels,
    "p6_percentiles": p6_percentiles,
    "p6_bounds": p6_bounds,
    "p8_containers": p8_containers,
    "p8_fill": p8_fill,
    "p9_found": p9_found,
    "p9_passages": p9_passages,
    "p10_found": p10_found,
    "p10_lengths": p10_lengths,
}
ORACLES = {
    "p6_bounds": f"""
        WITH v AS (
          SELECT 'seconds' AS metric, coalesce(outcome, '(none)') AS key, seconds AS v FROM journal
          UNION ALL SELECT 'pages', coalesce(outcome, '(none)'), pages FROM journal)
        SELECT metric, key, share::DOUBLE AS share, count(v) AS n, true AS within_bound, true AS bound_is_tight
        FROM v, unnest([{", ".join(map(str, SHARES))}]) AS s(share) WHERE v IS NOT NULL GROUP BY metric, key, share""",
}
