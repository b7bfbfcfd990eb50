"""Schemas, loading, constraint audits, exports and append sinks."""
