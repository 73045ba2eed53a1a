"""Training-data operators: scoring, privacy, near-duplicates, quality, extraction, media, packing, tokens, language."""
