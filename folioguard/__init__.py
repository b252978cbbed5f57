"""Document-integrity analytics on PySpark."""
