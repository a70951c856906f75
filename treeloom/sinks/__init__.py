"""Sinks: node snapshots, nested JSON, run records, history, archives."""
