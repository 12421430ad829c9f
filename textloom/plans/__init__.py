"""Whole queries: the registry behind ``__spark_entry__``."""
