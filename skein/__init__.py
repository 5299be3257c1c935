"""Skein: graph and partition analytics on Spark."""
