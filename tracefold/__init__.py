"""Trace compaction and analytics on PySpark."""
