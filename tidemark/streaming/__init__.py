"""Structured Streaming jobs and the tables they keep."""
