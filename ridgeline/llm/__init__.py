"""Operators for building training corpora: dedup, mixing, selection, scans, media, language spans."""
