"""Training-data operators: tokenising, packing, filtering and deduplicating text at scale.

Nothing outside this folder imports it.
"""
