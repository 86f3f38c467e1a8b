"""The word list as the models take it: read whole, with a checked size."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The largest word list that is sent to every executor: about 100 MB of Python strings.
BOUND = 1_000_000


def list_rows(lexicon: DataFrame, bound: int = BOUND) -> list[tuple[str, str]]:
    """(lang, word) of every distinct row, sorted. More than `bound` rows are an error, never a cut: a word
    that is left out would turn into a name, a misreading or an unmatched token."""
    rows = lexicon.where(F.col("word").isNotNull()).select("lang", "word").distinct().limit(bound + 1).collect()
    if len(rows) > bound:
        raise ValueError(f"the word list has more than {bound} rows: raise `bound` where executors have the memory")
    return sorted((r[0] or "", r[1]) for r in rows)


def listed_words(lexicon: DataFrame, bound: int = BOUND) -> list[str]:
    """The distinct words in lower case, sorted."""
    return sorted({w.lower() for _, w in list_rows(lexicon, bound)})
