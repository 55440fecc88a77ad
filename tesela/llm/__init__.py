"""Operators on text collections and match graphs; nothing else in tesela imports this package."""
