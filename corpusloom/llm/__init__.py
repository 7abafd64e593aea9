"""Training-data operators: scoring, near-duplicates, fingerprints, media, mixing, tokenizing and filters.

Nothing outside this folder imports it; ``registry.queries()`` names its queries.
"""
