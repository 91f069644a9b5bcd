"""Operators on long tables of chains.

Unless an operator says otherwise: (keys, pos) is unique, empty tables give empty results, and rows whose key is null are a
chain of their own in groups and windows and meet nothing in joins.
"""
