"""Retrieval, write-path and lifecycle operators as plan builders over DataFrames."""
