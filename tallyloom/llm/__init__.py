"""Training-data operators: text quality, deduplication, personal data, tokenization. Nothing else in the library imports this."""
