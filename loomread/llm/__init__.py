"""Operators for preparing training text at corpus scale.

Nothing else in ``loomread`` imports this subpackage; it can be removed whole.
"""
