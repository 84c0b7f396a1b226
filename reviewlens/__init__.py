"""Review mining and payment reconciliation as Spark DataFrame jobs."""
