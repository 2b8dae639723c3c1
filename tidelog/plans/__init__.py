"""Parameterised queries built from the operators."""
