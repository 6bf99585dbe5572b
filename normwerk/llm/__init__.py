"""Operators for preparing language-model training data.

Nothing outside this subpackage imports it.  Every operator takes and returns
DataFrames; Python runs only inside Arrow batches that Spark partitions.
"""
