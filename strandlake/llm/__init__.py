"""Operators for cleaning and preparing language-model training text."""
