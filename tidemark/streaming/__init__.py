"""Change streams as Structured Streaming."""
