"""Dependency retained-size analytics and corpus preparation on PySpark."""
