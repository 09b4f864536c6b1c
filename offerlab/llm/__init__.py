"""Operators of a training-data pipeline; nothing else in the library imports this folder.

Each module holds one operator with a general interface on DataFrames;
``queries`` registers one query per operator over the driver's tables. Column names that begin with two underscores are the operators' own.
"""
