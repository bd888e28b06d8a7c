"""Execution helpers shared by the iterative operators."""
