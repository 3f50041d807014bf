"""tessera: a Spark-first engine for versioned, incremental and constraint data."""
