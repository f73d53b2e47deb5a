"""Structured Streaming driver, state versions and sinks."""
