"""Operators for large text corpora used as training data.

Every operator is a function from DataFrames to a DataFrame.  ``queries``
binds each one to the tables of a data folder.
"""
