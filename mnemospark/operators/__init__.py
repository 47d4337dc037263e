"""Operators: plain DataFrame transformations. Time is an argument."""
