"""All registered queries."""

from . import corpus_queries, learning_queries, link_queries, message_queries, store_queries, stream_queries  # noqa: F401
from .registry import QUERIES, SQL  # noqa: F401
