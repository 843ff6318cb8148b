"""Text analytics for large collections, written as Spark DataFrame operators."""
