"""Training-data operators: ten corpus operators and the queries that apply them.

Nothing outside this package imports it.
"""
