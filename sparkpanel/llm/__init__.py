"""Operators for large training corpora: deduplication, scoring, cleaning, tokenising."""
