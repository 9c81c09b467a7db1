"""Compositions of operators: evaluation runs and reports."""
