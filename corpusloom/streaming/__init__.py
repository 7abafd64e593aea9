"""Resumable and incremental runs."""
