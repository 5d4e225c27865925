"""Readers: the star-schema tables as facts, nodes and edges; file trees as content."""
