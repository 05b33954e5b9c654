"""Training-data operators for very large document collections.

Nothing else in the library imports this subpackage; ``registry`` holds the
queries that apply every operator to its whole table.
"""
