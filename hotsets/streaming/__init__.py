"""Incremental form of the weekly access table (Structured Streaming)."""
