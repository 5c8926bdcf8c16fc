"""Readers, writers and the lifecycle of stored datasets."""
