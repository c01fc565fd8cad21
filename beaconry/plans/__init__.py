"""Whole-signal processing and the registered queries."""
