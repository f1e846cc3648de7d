"""Operators for preparing text corpora: cleaning, near-duplicates, grouping, splitting, language, tokens, packing, quality.

Nothing outside this subpackage imports it.
"""
