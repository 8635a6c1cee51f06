"""tidelake: retail lake loading, cleaning and quality checks as Spark DataFrame jobs."""
