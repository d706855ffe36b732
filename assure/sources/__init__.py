"""Readers with fixed schemas, and normalisers that split valid rows, quarantine and lineage."""
