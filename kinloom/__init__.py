"""Record-linkage and register analytics expressed as Spark DataFrame jobs."""
