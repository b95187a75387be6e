"""Structured Streaming: replayed events, detection on the stream, idempotent landing."""
