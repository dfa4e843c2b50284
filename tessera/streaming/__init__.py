"""Structured Streaming views of the event log."""
