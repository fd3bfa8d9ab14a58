"""Posting and application analytics on Spark."""
