"""Operators of a training-data pipeline: dedup, scoring, formatting, mixing and tokenisation.

Nothing outside this subpackage imports it; ``queries`` holds what the entry
module registers.
"""
