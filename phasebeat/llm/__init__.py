"""Operators for preparing training text: mixing, duplicates, quality, language, leaks, sharding, personal data, toxicity.

Nothing else in the library imports this subpackage.  Each operator takes and returns DataFrames and
reads only the columns it names, so other columns of the input may have any names.
"""
