"""Operators for preparing training data: packing, deduplication, fingerprints, filters, tokens, classifiers."""
