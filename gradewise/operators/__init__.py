"""Analytic operators over DataFrames."""
