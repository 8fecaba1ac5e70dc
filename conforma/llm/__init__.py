"""Operators of large-scale training-data preparation, on Spark.

Nothing else in the package imports this subpackage, so it can be removed as a whole.
"""
