"""millrace: a Spark-first medallion engine (landing, bronze, silver, gold, quality, reconciliation)."""
