"""Inputs and expected results over the given test tables; not part of the library."""
