"""Operators for preparing large text collections (ten of them, one module each).

Nothing else in the package imports this subpackage; deleting it leaves the rest whole.
"""
