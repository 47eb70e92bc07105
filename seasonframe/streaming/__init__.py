"""Structured Streaming: user changes applied as they come."""
