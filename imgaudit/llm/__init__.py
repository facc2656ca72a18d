"""Operators of a training-data pipeline over tables of documents, pages and benchmarks.

Nothing else in ``imgaudit`` imports this subpackage. ``queries`` holds the registered
queries; each operator has a module of its own with a general interface.
"""
