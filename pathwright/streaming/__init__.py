"""Structured Streaming forms of the checkpointed batch loops."""
