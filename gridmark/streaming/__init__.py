"""Structured Streaming forms of evaluation and live-frame selection."""
