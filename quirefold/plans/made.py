"""One made page beside the tables, for queries that find nothing in them: a bullet, option labels, halves of a word,
an open bracket, a word under a graphic, a line read twice, small print, and a planned page without words.
`words_too`, `blocks_too` and `plan_too` are the tables with its rows; the SQL names are the same relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quirefold.session import table

DOC = -1
_WORDS = "doc_id, page, word_no, text, alternative, x0, y0, x1, y1, line_id, confidence"
_WORD_TYPES = "doc_id bigint, page int, word_no int, text string, alternative string, x0 double, y0 double, x1 double, y1 double, line_id array<int>, confidence double"


def _w(no: int, text: str, x0: float, y0: float, x1: float, line: int, alternative: str | None = None, height: float = 10.0, c: float = 0.95) -> tuple:
    return (DOC, 0, no, text, alternative, x0, y0, x1, y0 + height, [1, line], c)


WORDS = [
    _w(1, "o", 10.0, 100.0, 14.0, 1), _w(2, "item", 30.0, 100.0, 60.0, 1), _w(3, "a)", 10.0, 120.0, 18.0, 2), _w(4, "6)", 60.0, 120.0, 68.0, 2), _w(5, "memo", 10.0, 140.0, 40.0, 3, "memorandum"), _w(6, "randum", 44.0, 140.0, 80.0, 3),
    _w(7, "(net", 10.0, 160.0, 40.0, 4), _w(8, "total", 45.0, 160.0, 80.0, 4), _w(9, "sealed", 10.0, 200.0, 50.0, 5), _w(10, "twice", 10.0, 240.0, 50.0, 6), _w(11, "twlce", 11.0, 240.5, 50.0, 7, c=0.5), _w(12, "xqzv", 10.0, 300.0, 20.0, 8, height=5.0, c=0.3), _w(13, "zzqk", 22.0, 300.0, 32.0, 8, height=5.0, c=0.3),
]
_GRAPHIC = (DOC, 0, 1, "graphic", 0.0, 195.0, 100.0, 215.0)
_PLAN = [(DOC, 1, "OCR")]


def _put(v) -> str:
    if isinstance(v, list):
        return "[" + ", ".join(map(str, v)) + "]"
    return "NULL" if v is None else str(v) if isinstance(v, (int, float)) else f"'{v}'"


def _rows(rows: list[tuple]) -> str:
    return ", ".join("(" + ", ".join(map(_put, r)) + ")" for r in rows)


WORDS_TOO = f"words_too AS (SELECT {_WORDS} FROM words UNION ALL SELECT * FROM (VALUES {_rows(WORDS)}) AS v({_WORDS}))"
BLOCKS_TOO = f"blocks_too AS (SELECT doc_id, page, block_no, block_type, x0, y0, x1, y1 FROM blocks UNION ALL SELECT * FROM (VALUES {_rows([_GRAPHIC])}) AS v(doc_id, page, block_no, block_type, x0, y0, x1, y1))"
PLAN_TOO = f"plan_too AS (SELECT doc_id, page, route FROM page_plan UNION ALL SELECT * FROM (VALUES {_rows(_PLAN)}) AS v(doc_id, page, route))"


def words_too(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "words").select(*_WORDS.split(", ")).unionByName(spark.createDataFrame(WORDS, _WORD_TYPES))


def blocks_too(spark: SparkSession, d: str) -> DataFrame:
    made = spark.createDataFrame([_GRAPHIC], "doc_id bigint, page int, block_no int, block_type string, x0 double, y0 double, x1 double, y1 double")
    return table(spark, d, "blocks").select(made.columns).unionByName(made)


def plan_too(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "page_plan").select("doc_id", "page", "route").unionByName(spark.createDataFrame(_PLAN, "doc_id bigint, page int, route string"))
