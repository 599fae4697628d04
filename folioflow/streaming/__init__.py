"""Structured Streaming counterparts of the batch flows."""
