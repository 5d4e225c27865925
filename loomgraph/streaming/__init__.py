"""Structured Streaming jobs: incremental forms of the state queries."""
