"""All queries over the standard tables."""

from . import box_queries, io_queries, review_queries, text_queries, vector_queries
from .base import QUERIES, SQL

__all__ = ["QUERIES", "SQL", "box_queries", "io_queries", "review_queries", "text_queries", "vector_queries"]
