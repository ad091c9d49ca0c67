"""Operators that a training-data pipeline needs, over plain DataFrames.

Nothing else in the package imports this subpackage.  Each ``opN_*`` module holds one operator with a
general interface, and a ``query(spark, sf_dir)`` that applies it to a whole table and derives the
digest columns.
"""
