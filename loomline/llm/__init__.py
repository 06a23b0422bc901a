"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it; ``queries`` lists what it offers to
the driver contract.
"""
