"""Training-data operators: fingerprints, language, deduplication, search, licences, archives, mixing, quality, packing."""
