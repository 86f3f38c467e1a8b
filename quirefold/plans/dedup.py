"""Problem 7: messages delivered more than once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quirefold.operators.once import SeenLedger, distinct_messages, repeated, with_identity
from quirefold.session import table, work_path


def _ledger(spark: SparkSession) -> SeenLedger:
    return SeenLedger(spark, work_path(spark, "ledger"))


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    arrivals = with_identity(table(spark, sf_dir, "journal").select("seq", "file", "time")).select("seq", "name", "instant")
    return repeated(arrivals, _ledger(spark))


def p7_messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per delivery outcome: rows, messages and the copies that were dropped."""
    journal = table(spark, sf_dir, "journal").select("seq", "file", "time", "outcome")
    kept = distinct_messages(journal, _ledger(spark), rounds=2)  # two deliveries, the second against the ledger of the first
    rows = journal.groupBy("outcome").agg(F.count("*").alias("n_rows"))
    return rows.join(kept.groupBy("outcome").agg(F.count("*").alias("n_messages")), "outcome", "left").withColumn(
        "n_dropped", F.col("n_rows") - F.col("n_messages")
    )


QUERIES = {"p7_found": p7_found, "p7_messages": p7_messages}

_NAMED = r"""
  named AS (
    SELECT seq, outcome,
      regexp_replace(regexp_replace(regexp_replace(trim(file), '\\+', '/', 'g'), '/(\./|/)+', '/', 'g'), '^(\./+)+', '') AS name,
      CASE WHEN regexp_matches(time, '[T ].*([Zz]|[+-]\d\d:\d\d)$') THEN time ELSE time || 'Z' END::TIMESTAMPTZ AS instant
    FROM journal),
  ranked AS (SELECT seq, outcome, row_number() OVER (PARTITION BY name, instant ORDER BY seq) AS k FROM named)
"""
ORACLES = {
    "p7_found": f"WITH {_NAMED} SELECT seq FROM ranked WHERE k > 1",
    "p7_messages": f"""WITH {_NAMED} SELECT outcome, count(*) AS n_rows, count(*) FILTER (k = 1) AS n_messages,
      count(*) FILTER (k > 1) AS n_dropped FROM ranked GROUP BY outcome""",
}
