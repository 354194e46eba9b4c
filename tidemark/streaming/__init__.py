"""The same pipeline on Structured Streaming."""
