"""Structured Streaming: continuous intake and buffered flush."""
