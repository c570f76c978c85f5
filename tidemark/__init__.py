"""tidemark: supply-risk analytics as Spark DataFrame jobs."""
