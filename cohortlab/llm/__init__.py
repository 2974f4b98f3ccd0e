"""Operators of a training-data pipeline over tables of text. Nothing else in the library imports this package."""
