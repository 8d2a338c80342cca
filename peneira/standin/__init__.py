"""Job-alert views over the bundled TPC-H-like tables.

The driver tables hold no postings, so these views derive sources, messages, postings,
profiles and evidence from whole tables, row by row and without randomness.
"""
