"""Composite plans: search, ingest, the engine."""
