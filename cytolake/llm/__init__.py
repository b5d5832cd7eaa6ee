"""Operators for preparing large text corpora: filtering, deduplication, mixing, search and tokenizing."""
