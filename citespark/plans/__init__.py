"""Whole studies composed from the operators."""
