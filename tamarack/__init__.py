"""Spark-first engine for turning raw listings, pages and text corpora into ranked, explainable tables."""

__version__ = "0.1.0"
