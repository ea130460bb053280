"""Readers, writers and the keep-first upsert."""
