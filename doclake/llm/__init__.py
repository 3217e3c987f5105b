"""Operators for preparing training text for language models."""
