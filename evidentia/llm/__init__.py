"""Training-data operators: quality, tokenising, mixing, secrets, URLs, dedup, toxicity, media."""
