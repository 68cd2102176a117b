"""Queries over a data folder, composed from the operators."""
