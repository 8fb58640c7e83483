"""Readers and writers for match files, documents, feeds and pages."""
