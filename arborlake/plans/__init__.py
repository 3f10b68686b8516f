"""Whole plans: building an index, and the registered queries."""
