"""Operators for preparing large text collections for training; nothing else in the library imports this package."""
