"""Operators of a training-data pipeline over document tables.

Nothing outside this package imports it. Each operator takes DataFrames with named
columns, reads only those columns, and states its result for nulls, empty and repeated
rows in its docstring.
"""
