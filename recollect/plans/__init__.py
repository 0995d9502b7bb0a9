"""Registered queries, their SQL, and the memory-shaped views they run on."""
