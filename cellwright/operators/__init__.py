"""Operators over tables; canonical frames are long: (row id, column, ...)."""
