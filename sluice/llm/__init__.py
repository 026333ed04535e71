"""Operators for preparing language-model training data, each usable on its own.

Nothing outside this subpackage imports it; the query registry is
:mod:`sluice.llm.queries`.
"""
