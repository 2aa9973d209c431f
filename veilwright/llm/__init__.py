"""Operators for preparing training data: de-duplication, scans, classifiers, packing, tokens, archives."""
