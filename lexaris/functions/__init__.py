"""Scalar, text and vector expressions used by the operators."""
