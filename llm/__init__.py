"""Operators for preparing training text: cleaning, deduplication, mixing, tokenizing, search."""
