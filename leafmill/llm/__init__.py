"""Operators that prepare book text for language-model training.

Nothing outside this package imports it.
"""
