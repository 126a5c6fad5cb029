"""Operators for preparing large text collections as training data.

Each module holds one operator with its own interface; ``queries`` applies
them to the supplied tables. Nothing outside this subpackage imports it.
"""
