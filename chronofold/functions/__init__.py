"""Scalar functions as column expressions, and the route codec."""
