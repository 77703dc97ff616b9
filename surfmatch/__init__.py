"""Batch jobs for large-scale comparison of surface marks, as Spark DataFrame code."""
