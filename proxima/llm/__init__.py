"""Operators of a training-data pipeline: deduplication, extraction, fingerprints, packing,
archives, tokenizer counts and language identification.

Nothing else in the library imports this subpackage.  Each module states its method, its rules
for nulls, empty texts, ties and repeated rows, and what it returns.
"""
