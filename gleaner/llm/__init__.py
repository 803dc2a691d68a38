"""Operators that prepare training data: deduplication, filtering, mixing and tokenising."""
