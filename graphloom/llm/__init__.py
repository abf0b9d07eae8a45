"""Operators for preparing training data at scale.

Nothing else in the package imports this one.  The registered queries and
their SQL are in :mod:`graphloom.llm.registry`.
"""
