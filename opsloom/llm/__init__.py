"""Operators for preparing training text: decontamination, near-duplicates,
packing, token files, extraction, quality sampling and vector search.

Nothing else in the library imports this subpackage. Every operator takes and
returns DataFrames; per-row Python works on Arrow batches inside tasks.
"""
