"""Container-catalog analytics on Spark."""
