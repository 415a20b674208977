"""Operators that Spark has no syntax for, as compositions of those it has."""
