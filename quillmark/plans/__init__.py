"""Registered queries of the library over the given tables, with the SQL they are held against."""

from . import datasets_queries, export_queries, files_queries, layout_queries, recognition_queries, records_queries, streaming_queries, text_queries
from .registry import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES", "datasets_queries", "export_queries", "files_queries", "layout_queries", "recognition_queries", "records_queries", "streaming_queries", "text_queries"]
