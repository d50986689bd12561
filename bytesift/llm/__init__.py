"""Operators for preparing training data: one module each, plus the queries over the driver's tables.

Nothing else in the package imports this subpackage.
"""
