"""Network fleet analytics on Spark."""
