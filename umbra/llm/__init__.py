"""Operators for preparing language-model training corpora at cluster scale.

Nothing outside this subpackage imports it; it can be removed as a whole.
"""
