"""Corpus preparation operators: quality, dedup, privacy, toxicity, scoring, mixing, tokenising."""
