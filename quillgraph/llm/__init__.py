"""Training-data operators for large text corpora.

Nothing outside this subpackage imports it.  Each module holds one operator
and every operator takes and returns DataFrames.
"""
