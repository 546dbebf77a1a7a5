"""Streaming ingestion and the permission cache."""
