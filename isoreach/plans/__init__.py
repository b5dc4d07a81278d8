"""Whole preparations and reports composed from the operators."""
