"""Time-resolved, multi-assay measurement analytics expressed as Spark DataFrame jobs."""
