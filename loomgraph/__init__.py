"""Context-graph analytics as Spark DataFrame jobs."""
