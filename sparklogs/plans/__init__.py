"""Parameters of searches and counts, and the registered queries with their SQL."""
