"""Operators for preparing training data: one module an operator, their queries in ``queries``."""
