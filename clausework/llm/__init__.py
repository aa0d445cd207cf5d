"""Training-data operators: duplicates, quality, safety, tokenisation and language-model scoring over document tables."""
