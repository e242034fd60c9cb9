"""Structured Streaming jobs: stage timing, attempt limits, bounded logs."""
