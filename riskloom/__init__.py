"""riskloom: source-risk analytics for agent projects as Spark DataFrame jobs."""
