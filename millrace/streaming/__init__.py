"""Structured Streaming with the batch operators."""
