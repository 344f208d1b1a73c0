"""Readers, writers, table definitions and the benchmark-table adapter."""
