"""Structured Streaming pipelines: three topics into the stored tables, and stateful monitors."""
