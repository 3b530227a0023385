"""Operators for preparing language-model training data. Nothing else in busline imports this."""
