"""State-sequence analytics on Spark."""
