"""Operators for preparing training data: packing, mixing, sharding, counting,
deduplication, extraction, tokenisation, scoring and quality rules.

Nothing outside this folder imports it.
"""
