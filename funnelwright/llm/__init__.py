"""Operators for preparing training text: one module for each, nothing else here imports them."""
