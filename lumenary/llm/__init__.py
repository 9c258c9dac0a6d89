"""Operators for preparing language-model training data.

Nothing outside this package imports it; it stands on Spark, numpy and pyarrow alone.
"""
