"""Readers, writers and fetch hooks."""
