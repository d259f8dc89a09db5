"""Batch and streaming jobs for file-activity audit logs on Spark."""
