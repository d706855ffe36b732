"""Structured Streaming forms of ingest and of waiting for bank credits."""
