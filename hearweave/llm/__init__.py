"""Operators of training-data pipelines: tokenizers, archives, decontamination, secrets,
URL lists, nearest neighbours, near-duplicate joins, quality and toxicity.

Nothing outside this subpackage imports it; it imports nothing from the rest of the library.
"""
