"""Readers, writers, entity schemas and the adapters for the provided tables."""
