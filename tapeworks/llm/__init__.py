"""Training-data operators: extraction, deduplication, filtering, packing and archives.

Nothing else in the library imports this subpackage. `queries.py` registers one query per operator.
"""
