"""Structured Streaming versions of the event pipelines."""
