"""Exact dense-vector retrieval over article collections, as Spark DataFrame jobs."""

from vectrail.plans.build import build_articles, build_codes, build_vectors
from vectrail.plans.retriever import Retriever

__all__ = ["Retriever", "build_articles", "build_codes", "build_vectors"]
