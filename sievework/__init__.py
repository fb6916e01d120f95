"""Data-quality audit of tables and file collections, expressed as Spark jobs."""
