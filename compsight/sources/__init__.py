"""Readers, writers and test-table stand-ins."""
