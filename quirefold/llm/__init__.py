"""Operators on the text of documents for training data. Nothing else in the library imports this subpackage."""
