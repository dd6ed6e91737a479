"""Operators for the problems of text training data; nothing else in the package imports this folder."""
