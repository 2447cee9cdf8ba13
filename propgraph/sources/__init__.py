"""Readers of building models, requirement documents, test sets and tables."""
