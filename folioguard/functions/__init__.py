"""Scalar functions: Column to Column, built-ins only."""
