"""Operators for large text corpora: scans, language, dedup, archives, scoring."""
