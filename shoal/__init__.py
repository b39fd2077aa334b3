"""A DataFrame-first analytics library for PySpark."""
