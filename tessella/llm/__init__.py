"""Operators for preparing training text at corpus scale.

Nothing else in the library imports this subpackage.  Every operator takes
DataFrames and column names and returns a DataFrame; ``queries`` holds the thin
queries over the standard tables.
"""
