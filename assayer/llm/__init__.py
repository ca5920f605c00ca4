"""Operators for preparing training data at corpus scale, one module per operator.

Nothing else in the library imports this package; its queries are in ``workload``.
"""
