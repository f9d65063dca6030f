"""Queries and oracle SQL of this subpackage, by name."""

from importlib import import_module

MODULES = ["license_scan", "quality", "token_counts", "near_duplicates", "vector_search", "toxicity", "sentencepiece_codec", "fingerprint", "private_data", "mixing", "prefix_trie", "conversation_repair", "warc"]


def queries() -> dict:
    return {k: f for m in MODULES for k, f in import_module(f"{__package__}.{m}").QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {k: q for m in MODULES for k, q in import_module(f"{__package__}.{m}").ORACLES.items()}
