"""Urban traffic analytics on Spark."""
