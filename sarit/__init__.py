"""Corpus processing on Spark: cleaning, counting, splitting, sampling, packing and scoring of text tables."""
