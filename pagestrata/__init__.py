"""Spark-native analytics over the positioned text blocks of technical documents."""

from .plans.document import analyzed, documents, pages
from .sources.readers import open_document, read_blocks

__all__ = ["analyzed", "documents", "open_document", "pages", "read_blocks"]
