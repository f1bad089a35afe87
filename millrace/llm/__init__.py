"""Operators for building training corpora out of raw documents.

Nothing outside this package imports it.  Each module holds one operator with
its general interface; ``queries`` binds them to the driver's tables.
"""
