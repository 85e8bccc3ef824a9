"""railspan: Spark transforms for public-transport analytics."""
