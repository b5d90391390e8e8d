"""Time-aligned annotation analytics on Spark."""
