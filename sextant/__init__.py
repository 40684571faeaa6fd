"""Retrieval, versioning and code analytics as DataFrame-to-DataFrame operators on Spark."""
