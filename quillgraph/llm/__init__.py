"""Operators for preparing language-model training data at cluster scale.

Nothing outside this subpackage imports it, so it can be removed as a whole.
"""
