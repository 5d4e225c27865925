"""DataFrame operators that the queries are built of."""
