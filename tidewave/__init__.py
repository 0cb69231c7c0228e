"""Time-series analytics over paired, multi-channel recordings, as Spark DataFrame and SQL plans."""
