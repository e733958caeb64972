"""Operators for language-model training data.

Nothing outside this sub-package imports it.
"""
