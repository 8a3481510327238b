"""Training-data operators: deduplication, decontamination, scans, quality, mixing.

Each module holds one operator with a general interface and the thin ``opN_*``
query that applies it to a whole table.  Nothing else in the library imports
this subpackage.
"""
