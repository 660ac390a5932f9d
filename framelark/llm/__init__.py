"""Operators of a training-data pipeline over documents and web pages.

Nothing else in the library imports this subpackage. `queries` registers one
query per operator; each operator module has its own general interface.
"""
