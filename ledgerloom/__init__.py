"""Document and statement analytics on Spark."""
