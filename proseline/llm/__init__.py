"""Training-data operators: near-duplicates, media columns, quality, mixing, packing, extraction, licences, chat, language."""
