"""Scalar functions whose semantics differ from Spark's own, and user functions."""
