"""Operators that prepare training data for language models, and the queries that apply them."""
