"""Operators for preparing training corpora.

Nothing else in the library imports this subpackage.  Modules are imported one
by one so that a Python worker loads only what its task needs.
"""
