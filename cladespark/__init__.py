"""Feature discovery and association analytics on PySpark."""
