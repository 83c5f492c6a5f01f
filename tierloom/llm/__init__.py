"""Operators for preparing language-model training data at scale.

Nothing outside this folder imports it. Every operator takes and returns DataFrames; the
queries over the standard tables are in :mod:`tierloom.llm.registry`.
"""
