"""Whole steps of a business date, composed from the operators."""
