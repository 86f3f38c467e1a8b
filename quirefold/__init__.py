"""Document-structure analytics on Spark: positioned words, page plans, text blocks and run journals."""

__version__ = "0.1.0"
