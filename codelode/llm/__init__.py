"""Operators for training data: one module per problem, queries in ``queries``."""
