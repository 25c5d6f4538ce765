"""Operators for large-scale training-data pipelines.

Nothing else in the library imports this subpackage; deleting it leaves the
rest working.  Each module holds one operator with a general interface and a
thin query ``opN_<name>(spark, sf_dir)`` that derives the digest columns.
"""
