"""Incremental forms of batch reports."""
