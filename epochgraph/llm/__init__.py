"""Operators of a training-data pipeline: tokens, packing, chat text, near-duplicates, classifiers, media and URL rules."""
