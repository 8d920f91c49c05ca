"""Training-data operators: token counts, filters, deduplication, packing, archives.

Nothing outside this package imports it. Every operator takes and returns
DataFrames; `queries.py` holds the thin production queries over the test tables.
"""
