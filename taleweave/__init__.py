"""Narrative-memory analytics on Spark: typed story graph, hybrid retrieval, time-versioned state."""
