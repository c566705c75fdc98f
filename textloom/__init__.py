"""Text retrieval and corpus analytics as Spark DataFrame operations."""
