"""Specifications, evaluation, reports and the registered queries."""
