"""citetrail: tracing where claims come from, on PySpark."""
