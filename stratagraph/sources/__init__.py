"""Readers and the snapshot store."""
