"""Whole studies composed from the operators, and the query catalogue."""
