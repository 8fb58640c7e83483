"""Structured Streaming jobs: match ingest, alerts and conversation context."""
