"""Column functions: URL algebra and HTML-to-text/links as native Spark expressions."""
