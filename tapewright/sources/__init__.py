"""Readers: landed vendor payloads, topics and stored tables."""
