"""Operators for building training data: one module for each operator, and the queries that apply them."""
