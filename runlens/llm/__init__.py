"""Training-data operators: thirteen corpus operators and their queries.

Nothing else in the library imports this package; it may be removed as a folder.
"""
