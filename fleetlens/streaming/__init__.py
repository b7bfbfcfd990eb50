"""Structured Streaming jobs over probe rows and alerts."""
