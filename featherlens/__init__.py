"""Feature-matrix analytics on Spark: which features vary, which carry the signal."""
