"""Relational operators over documents, units, scenes and evaluation rows."""
