"""Operators for preparing training corpora, each a Spark job over DataFrames.

Nothing outside this subpackage imports it.
"""
