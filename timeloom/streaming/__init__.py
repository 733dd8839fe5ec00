"""Structured Streaming: record assembly and merging of live logs."""
