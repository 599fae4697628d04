"""Operators for preparing training text at scale, each built by a method of its own."""
