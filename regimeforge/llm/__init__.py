"""Text-corpus operators: cleaning, deduplication, scoring and tokenising of documents.

Nothing outside this subpackage imports it.
"""
