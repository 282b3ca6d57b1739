"""Case analytics on event tables, expressed as Spark DataFrame operators."""
