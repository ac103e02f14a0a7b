"""Scalar and array functions as Spark columns."""
