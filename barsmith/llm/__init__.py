"""Operators for preparing large text corpora: tokenising, deduplication, packing, scanning and scoring."""
