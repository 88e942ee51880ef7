"""Event-to-metric analytics and a Data Vault warehouse, written as Spark jobs."""
