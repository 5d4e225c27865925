"""Column functions: text patterns, urls, digests. All are built of Spark's own functions."""
