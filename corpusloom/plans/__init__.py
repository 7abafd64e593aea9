"""Registered queries and whole plans."""
