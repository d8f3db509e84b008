"""Training-data operators: deduplication, classifiers, tokenizers, media, mixing."""
