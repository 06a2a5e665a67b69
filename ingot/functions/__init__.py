"""Scalar functions (F1-F13) as Spark Column builders: see :mod:`ingot.functions.expr`."""
