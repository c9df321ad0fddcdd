"""Readers, keyed merges and writers."""
