"""Whole analyses as plans over the operators."""
