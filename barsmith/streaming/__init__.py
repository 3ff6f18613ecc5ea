"""Bars, book state and archives as Structured Streaming queries."""
