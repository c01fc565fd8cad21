"""Sink surface, fan-out, retry and ledger."""
