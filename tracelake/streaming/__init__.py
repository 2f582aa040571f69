"""Structured Streaming: traces as they arrive, their conformance by process, alerts."""
