"""Operators for preparing training text at scale: cleaning, deduplication, scanning and tokenizing."""
