"""Training-data operators: text quality, deduplication, extraction, search, mixing and tokenizing on Spark."""
