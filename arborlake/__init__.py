"""Hierarchical storage-inventory analytics and text-corpus preparation on Spark."""
