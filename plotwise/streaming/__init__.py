"""Structured Streaming jobs that keep the tables current."""
