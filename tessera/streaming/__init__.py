"""Structured Streaming jobs and the run ledger."""
