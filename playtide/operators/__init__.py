"""Analytic operators as DataFrame transformations."""
