"""Operators for preparing language-model training text (self-contained subpackage)."""
