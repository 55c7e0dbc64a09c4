"""Operators for large text and vector corpora.

Nothing else in the library imports this subpackage; the driver contract adds
its queries only when it can be imported.
"""
