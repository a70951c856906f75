"""Structured Streaming jobs: archives on arrival, and a history that grows by append."""
