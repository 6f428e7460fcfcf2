"""Ring-aware polygon analytics on Spark."""
