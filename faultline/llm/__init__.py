"""Operators for preparing training data: one module per operator, one for the queries."""
