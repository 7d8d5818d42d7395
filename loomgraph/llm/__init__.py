"""Training-data operators: quality, language-model scores, dedup, licences, mixing, packing, media."""
