"""Structured Streaming forms of the tick (C6) and tracker (D7) operators."""
