"""Free text to clean tables on Spark: discovery, extraction, profiling and normalization as DataFrame operators."""
