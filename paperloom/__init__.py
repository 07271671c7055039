"""paperloom: document-retrieval analytics as Spark DataFrame, SQL and streaming jobs."""
