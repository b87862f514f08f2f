"""Incremental fitting of streams."""
