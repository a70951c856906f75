"""Whole jobs, made of the other packages' parts."""
