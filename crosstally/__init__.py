"""Two-party revenue reconciliation and sales analytics as PySpark DataFrame jobs."""
