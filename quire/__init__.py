"""Document reconstruction and analysis as Spark DataFrame operations."""
