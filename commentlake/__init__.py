"""Comment-sentiment analytics expressed as Spark DataFrame jobs."""
