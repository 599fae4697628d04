"""Whole flows composed from the functions and operators."""
