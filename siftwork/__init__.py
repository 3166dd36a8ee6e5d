"""Posting-to-profile matching on Spark: normalize, qualify, score, section, retrieve, rerank, review."""

__version__ = "0.1.0"
