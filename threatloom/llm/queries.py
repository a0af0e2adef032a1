"""Loads every module that registers queries."""

from . import byte_bpe, decontamination, embedding_dedup, hard_negatives, jaccard_join, license_scan, merkle, mixing, personal_data, sharding, token_counts, toxicity, url_reputation  # noqa: F401
from .catalogue import QUERIES, SQL  # noqa: F401
