"""A Spark-first engine for tagged media and document collections."""
