"""Operators for preparing training corpora: dedup, quality, mixing, packing, scoring."""
