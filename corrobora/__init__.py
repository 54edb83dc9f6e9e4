"""Evidence integration and sparse-count analytics as DataFrame-in, DataFrame-out Spark operators."""
