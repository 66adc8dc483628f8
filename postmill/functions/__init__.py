"""Scalar functions: plain Python kernels for parsers, Column functions for the rest."""
