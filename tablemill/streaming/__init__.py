"""Incremental and stateful versions on Structured Streaming."""
