"""Operators for preparing large text corpora: scoring, joins, deduplication, mixing and packing."""
