"""Operators on documents for language-model training; nothing outside imports this package."""
