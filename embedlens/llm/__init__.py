"""Operators for preparing training data: near-duplicates, decontamination, classifiers, extraction, packing."""
