"""Structured Streaming forms of the stateful router feedback."""
