"""textloom: corpus retrieval, quote checking and evaluation as Spark jobs over tables."""
