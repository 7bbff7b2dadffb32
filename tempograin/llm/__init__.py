"""Operators for preparing language-model training data, each with its query."""

from tempograin.llm import (  # noqa: F401
    decontamination, lexical_search, merkle_manifest, pii, preferences, quality_classifier, quality_rules, sentencepieces,
    sharding, simhash, suffix_dedup, token_counts, warc)
from tempograin.llm.common import all_oracles, all_queries

__all__ = ["all_queries", "all_oracles"]
