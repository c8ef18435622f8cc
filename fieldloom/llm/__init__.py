"""Operators for preparing language-model training data.

Nothing else in the package imports this subpackage. Every operator is a
function ``DataFrame -> DataFrame`` that selects only the columns it needs, so
extra input columns (also ones whose names clash with result columns) are
ignored unless an operator says that it returns its input's columns.
"""
