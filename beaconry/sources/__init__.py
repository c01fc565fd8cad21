"""Scans: envelopes and the documents inside them."""
