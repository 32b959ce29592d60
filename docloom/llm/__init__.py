"""Operators for preparing large text corpora: de-duplication, mixing, packing, counting, scoring and vector search."""
