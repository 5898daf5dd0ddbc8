"""Spark jobs for the data work around a large training corpus."""
