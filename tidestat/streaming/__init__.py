"""Incremental statistics with Structured Streaming."""
