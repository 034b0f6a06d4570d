"""Operators for preparing training text: thirteen methods, each a module of its own."""
