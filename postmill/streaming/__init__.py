"""Change feeds as Structured Streaming jobs."""
