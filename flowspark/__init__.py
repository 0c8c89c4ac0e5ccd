"""Flow-based network traffic analytics as Spark DataFrame operations."""
